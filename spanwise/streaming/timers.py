"""State with timers: runs and tracks that end when time has passed on, whether or not their recording says more.

These are the operators of :mod:`.stateful` on ``transformWithStateInPandas``. Each
group has one timer, moved with its last event; when the watermark passes it, the open
run is told or the live tracks are dropped, and the group's state is gone. The session
needs the RocksDB state store (:func:`use_rocksdb`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import tracks
from ..operators.signal import kept
from .stateful import RUN, TRACKED


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Timed(StatefulProcessor):
    """One value and at most one timer a group."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def keep(self, value: tuple, until_ms: int, now_ms: int) -> None:
        self.held.update(value)
        self.stop()
        self.handle.registerTimer(max(until_ms, now_ms + 1))

    def drop(self) -> None:
        self.held.clear()
        self.stop()

    def stop(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


class Runs(_Timed):
    schema = "state string, first_t double, last_t double, n long"

    def __init__(self, idle: float):
        self.idle = idle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        run, out = list(self.held.get()) if self.held.exists() else None, []
        for r in pd.concat(list(rows)).sort_values(["t", "event_id"]).itertuples():
            if run and run[0] == r.state:
                run[2], run[3] = r.t, run[3] + 1
            else:
                if run:
                    out.append((key[0], *run))
                run = [r.state, r.t, r.t, 1]
        self.keep(tuple(run), int((run[2] + self.idle) * 1000), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["user_id", "state", "first_t", "last_t", "n"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [(key[0], *self.held.get())] if self.held.exists() else []
        self.drop()
        yield pd.DataFrame(out, columns=["user_id", "state", "first_t", "last_t", "n"])


def state_runs(events: DataFrame, idle: float = 86_400.0, late: str = "1 day") -> DataFrame:
    """Closed runs of equal states (user_id, event_id, ts, state): when the next begins, or ``idle`` seconds after the last event."""
    timed = events.withWatermark("ts", late).withColumn("t", F.unix_micros("ts") / 1e6)
    return timed.groupBy("user_id").transformWithStateInPandas(Runs(idle), RUN, "Append", "EventTime")


class Tracks(_Timed):
    schema = "live string"

    def __init__(self, most_gap: float, least: float, bonus: float):
        self.most_gap, self.least, self.bonus = most_gap, least, bonus

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        live, fresh = json.loads(self.held.get()[0]) if self.held.exists() else [{}, 0]
        live = {int(k): (tuple(v[0]), v[1], v[2]) for k, v in live.items()}
        out, last = [], 0.0
        for when, found in tracks.frames_of(pd.concat(list(rows)), "t"):
            live, fresh, told = tracks.associate(live, fresh, when, found, self.most_gap, self.least, self.bonus)
            out += [(key[0], when, b[0], k) for b, k in zip(found, told)]
            last = when
        self.keep((json.dumps([live, fresh]),), int((last + self.most_gap) * 1000), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["rec", "t", "box_id", "track"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # tracks are gone; their number stays, so that none is given twice
        if self.held.exists():
            _, fresh = json.loads(self.held.get()[0])
            self.held.update((json.dumps([{}, fresh]),))
        yield pd.DataFrame([], columns=["rec", "t", "box_id", "track"])


def live_tracks(boxes: DataFrame, most_gap: float, least: float = 0.1, bonus: float = 0.2, late: str = "10 seconds") -> DataFrame:
    """``rec, t, box_id, track`` of boxes (rec, ts, t, box_id, label, x0..y1) that come in order of frames; a recording that stops keeps one number."""
    timed = boxes.withWatermark("ts", late)
    return timed.groupBy("rec").transformWithStateInPandas(Tracks(most_gap, least, bonus), TRACKED, "Append", "EventTime")


def change_peaks(changes: DataFrame, share: float, suppression: float, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Of each user's window of change scores (user_id, event_id, ts, value) the highest ``share``, then greedy suppression: ``user_id, start, event_id, t, value``.

    A window's threshold is its own exact quantile; a peak suppresses within its window only.
    """
    timed = changes.withWatermark("ts", late).withColumn("t", F.unix_micros("ts") / 1e6)
    w = timed.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.percentile("value", 1 - share).alias("q"), F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("s"), F.col("event_id").alias("i"), "t"))).alias("p"))
    high = F.filter("p", lambda x: -x["s"] >= F.col("q"))
    return w.select("user_id", F.col("w.start").alias("start"), F.explode(kept(high, suppression)).alias("k")).select("user_id", "start", F.col("k.i").alias("event_id"), "k.t", (-F.col("k.s")).alias("value"))
