from spanwise.streaming import stateful

SCHEMA = "event_id long, ts timestamp, user_id long, state string, value double"


def feed(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def events():
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    states = "a a b b b a".split()
    return [(i, start + timedelta(hours=i), 1, s, float(i)) for i, s in enumerate(states)] + [(9, start + timedelta(days=9), 2, "z", 1.0), (10, start + timedelta(days=30), 3, "z", 1.0)]


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_state_runs_close_in_order(spark, tmp_path):
    rows = events()
    run(stateful.state_runs(feed(spark, tmp_path, [rows[:4], rows[4:7], rows[7:]])), "runs")
    got = [(r.state, r.n) for r in spark.table("runs").where("user_id = 1").orderBy("first_t").collect()]
    assert got[:2] == [("a", 2), ("b", 3)]


def test_window_peaks_and_sessions(spark, tmp_path):
    stream = feed(spark, tmp_path, [events()])
    run(stateful.window_peaks(stream), "peaks")
    assert [(r.peak, r.n) for r in spark.table("peaks").where("user_id = 1").collect()] == [(5.0, 6)]
    run(stateful.sessions(stream), "sessions")
    assert [r.n for r in spark.table("sessions").where("user_id = 1").collect()] == [6]


def test_replayed_batches_add_nothing(spark, tmp_path):
    stream = feed(spark, tmp_path, [events(), events()])
    q = stateful.write_once(stream, str(tmp_path / "out"), "event_id", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(events())


def test_suppression_in_closed_sessions_is_that_of_the_batch(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from spanwise.operators import signal

    rng, start = random.Random(2), datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=rng.randrange(60 * 24 * 20)), i % 3, "p", round(rng.random(), 3)) for i in range(120)]
    rows += [(900 + u, start + timedelta(days=60), u, "end", 0.0) for u in range(3)] + [(990, start + timedelta(days=90), 7, "end", 0.0)]
    run(stateful.suppressed_sessions(feed(spark, tmp_path, [rows[:-1], rows[-1:], [(991, start + timedelta(days=91), 7, "end", 0.0)]]), 6 * 3600.0), "kept")
    got = {r.event_id for r in spark.table("kept").where("event_id < 120").collect()}
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("t", F.unix_micros("ts") / 1e6)
    assert got == {r.i for r in signal.suppress(batch, ["user_id"], "t", "event_id", "value", 6 * 3600.0).where("i < 120").collect()}


def test_live_tracks_are_those_of_the_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    from spanwise.operators import tracks

    start = datetime(2024, 1, 1)
    schema = "rec long, ts timestamp, t double, box_id long, label string, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, start + timedelta(seconds=f), start.timestamp() + f, 100 * f + k, "a", 10.0 * k + f, 0.0, 10.0 * k + f + 8, 8.0) for f in (0, 1, 2, 3, 30, 31) for k in range(2)]
    for part in (rows[:4], rows[4:8], rows[8:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "boxes"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "boxes"))
    run(stateful.live_tracks(stream, 5.0), "tracked")
    got = {r.box_id: r.track for r in spark.table("tracked").collect()}
    want = {r.box_id: r.track for r in tracks.track(spark.createDataFrame(rows, schema), "rec", "t", 5.0).collect()}
    assert got == want and set(want.values()) == {0, 1, 2, 3}
