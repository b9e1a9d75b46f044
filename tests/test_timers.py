"""Streams with timers and sketches against their batch forms, restarts included."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import signal, tracks
from spanwise.streaming import baselines, stateful, timers

EVENTS = "event_id long, ts timestamp, user_id long, state string, value double"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    timers.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, out, checkpoint):
    """Everything there is now, then stop: run again it goes on from the checkpoint."""
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()


def made_events(n=150):
    rng = random.Random(3)
    at = sorted(rng.randrange(60 * 24 * 12) for _ in range(n))
    return [(i, START + timedelta(minutes=m), rng.randrange(3), rng.choice("aab"), round(rng.gauss(0, 5), 3)) for i, m in enumerate(at)]


def plain_runs(rows):
    out, open_ = [], {}
    for i, ts, user, state, _ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if user in open_ and open_[user][0] == state:
            open_[user][2:] = [ts.timestamp(), open_[user][3] + 1]
        else:
            if user in open_:
                out.append((user, *open_[user]))
            open_[user] = [state, ts.timestamp(), ts.timestamp(), 1]
    return sorted(out + [(user, *v) for user, v in open_.items()])


def test_runs_close_by_the_next_or_by_their_timer_over_a_restart(spark, tmp_path):
    rows = made_events()
    end = [(900 + k, START + timedelta(days=400 + k), 99, "end", 0.0) for k in range(3)]
    for part in (rows[:50], rows[50:100]):
        write(spark, tmp_path / "in", part, EVENTS)
    job = lambda: timers.state_runs(read(spark, tmp_path / "in", EVENTS), idle=30 * 86_400.0, late="1 hour")
    run(job(), tmp_path / "out", tmp_path / "cp")
    for part in (rows[100:], end[:1], end[1:]):
        write(spark, tmp_path / "in", part, EVENTS)
    run(job(), tmp_path / "out", tmp_path / "cp")
    got = sorted((r.user_id, r.state, r.first_t, r.last_t, r.n) for r in spark.read.parquet(str(tmp_path / "out")).where("user_id < 99").collect())
    want = plain_runs([(i, ts.replace(tzinfo=None), u, s, v) for i, ts, u, s, v in rows])
    offset = got[0][2] - want[0][2]  # the machine's zone
    assert [(u, s, round(a - offset, 3), round(b - offset, 3), n) for u, s, a, b, n in got] == [(u, s, round(a, 3), round(b, 3), n) for u, s, a, b, n in want]


def test_timed_tracks_are_those_of_the_batch(spark, tmp_path):
    schema = "rec long, ts timestamp, t double, box_id long, label string, x0 double, y0 double, x1 double, y1 double"
    frames = [0, 1, 2, 3, 30, 31, 90]
    rows = [(rec, START + timedelta(seconds=f), float(f), 1000 * rec + 10 * f + k, "a", 10.0 * k + f % 30, 0.0, 10.0 * k + f % 30 + 8, 8.0) for f in frames for rec in (1, 2) for k in range(2) if not (rec == 2 and f > 3)]
    for part in (rows[:8], rows[8:14], rows[14:]):
        write(spark, tmp_path / "in", part, schema)
    run(timers.live_tracks(read(spark, tmp_path / "in", schema), 5.0, late="1 second"), tmp_path / "out", tmp_path / "cp")
    got = {r.box_id: r.track for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.box_id: r.track for r in tracks.track(spark.createDataFrame(rows, schema), "rec", "t", 5.0).collect()}
    assert got == want and max(want.values()) >= 5


def test_state_is_dropped_when_a_recording_stops(spark, tmp_path):
    rows = [(i, START + timedelta(minutes=i), i, "a", 0.0) for i in range(40)]
    end = [(900 + k, START + timedelta(days=30 + k), 99, "end", 0.0) for k in range(3)]
    for part in (rows, end[:1], end[1:2], end[2:]):
        write(spark, tmp_path / "in", part, EVENTS)
    q = timers.state_runs(read(spark, tmp_path / "in", EVENTS), idle=3600.0, late="1 hour").writeStream.format("memory").queryName("closed_runs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    assert max(held) >= 40 and held[-1] <= 6  # the last user's run and its timer
    assert spark.table("closed_runs").where("user_id < 99").count() == 40


def test_streamed_baselines_are_within_the_stated_error(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(i), START + timedelta(minutes=int(i) % 14_000), int(i) % 2, "s", float(v)) for i, v in enumerate(np.concatenate([rng.lognormal(1, 1.2, 30_000), rng.normal(0, 3, 10_000)]))]
    rows += [(-1, START, 0, "s", None), (-2, START, 0, "s", float("nan"))]
    rng.shuffle(rows)
    end = [(90_000 + k, START + timedelta(days=100 + k), 7, "end", 0.0) for k in range(3)]
    job = lambda: baselines.window_sketches(read(spark, tmp_path / "in", EVENTS), "user_id", "value", late="30 days")
    for part in (rows[:15_000], rows[15_000:28_000]):
        write(spark, tmp_path / "in", part, EVENTS)
    run(job(), tmp_path / "out", tmp_path / "cp")
    for part in (rows[28_000:], end[:1], end[1:]):
        write(spark, tmp_path / "in", part, EVENTS)
    run(job(), tmp_path / "out", tmp_path / "cp")
    sketches = spark.read.parquet(str(tmp_path / "out"))
    got = {r.user_id: r for r in baselines.baseline(sketches, "user_id").where("user_id < 7").collect()}
    for user in (0, 1):
        x = np.array([v for *_, u, _, v in rows if u == user and v is not None and v == v])
        error = baselines.rank_error()
        assert got[user].n == len(x) and abs((x <= got[user].median).mean() - 0.5) <= error + 1 / len(x)
        away = np.abs(x - got[user].median)
        assert abs((away <= got[user].mad / baselines.SPREAD).mean() - 0.5) <= 2 * error + 1.5 / baselines.POINTS
    batch = {r.user_id: r for r in baselines.baseline(baselines.window_sketches(spark.createDataFrame(rows, EVENTS), "user_id", "value"), "user_id").collect()}
    assert batch[0].n == got[0].n and batch[0].median == pytest.approx(got[0].median, rel=0.05)


def test_streamed_change_peaks_are_those_of_the_windows(spark, tmp_path):
    rows = made_events(400)
    end = [(900 + k, START + timedelta(days=400 + k), 99, "end", 0.0) for k in range(3)]
    for part in (rows[:200], rows[200:], end[:1], end[1:]):
        write(spark, tmp_path / "in", part, EVENTS)
    run(timers.change_peaks(read(spark, tmp_path / "in", EVENTS), 0.25, 3 * 3600.0, late="1 hour"), tmp_path / "out", tmp_path / "cp")
    got = {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).where("user_id < 99").collect()}
    table = spark.createDataFrame(rows, EVENTS).withColumn("t", F.unix_micros("ts") / 1e6).withColumn("day", F.window("ts", "1 day")["start"])
    top = table.groupBy("user_id", "day").agg(F.percentile("value", 0.75).alias("q"))
    want = signal.suppress(table.join(top, ["user_id", "day"]).where("value >= q"), ["user_id", "day"], "t", "event_id", "value", 3 * 3600.0)
    assert got == {r.i for r in want.collect()} and len(got) > 30


def test_timers_and_group_state_tell_the_same_runs(spark, tmp_path):
    rows = made_events(60) + [(900 + k, START + timedelta(days=400 + k), 99, "end", 0.0) for k in range(3)]
    for part in (rows[:60], rows[60:61], rows[61:]):
        write(spark, tmp_path / "in", part, EVENTS)
    run(timers.state_runs(read(spark, tmp_path / "in", EVENTS), late="1 day"), tmp_path / "a", tmp_path / "cpa")
    run(stateful.state_runs(read(spark, tmp_path / "in", EVENTS)), tmp_path / "b", tmp_path / "cpb")
    of = lambda p: sorted((r.user_id, r.first_t, r.n) for r in spark.read.parquet(str(tmp_path / p)).where("user_id < 99").collect())
    assert of("a") == of("b") and len(of("a")) > 20
