"""Structured Streaming forms: tumbling change peaks, runs and sessions with state, resumable sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import tracks
from ..operators.signal import kept

RUN = "user_id long, state string, first_t double, last_t double, n long"


def window_peaks(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per user and tumbling window the largest value and how many events, late ones dropped by watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Per user sessions that end after a gap, with their highest value."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))


def _runs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current = list(state.get) if state.exists else None
    out = []
    rows = pd.concat(list(batches)).sort_values(["t", "event_id"]) if not state.hasTimedOut else pd.DataFrame()
    for r in rows.itertuples():
        if current and current[0] == r.state:
            current[2], current[3] = r.t, current[3] + 1
        else:
            if current:
                out.append((key[0], *current))
            current = [r.state, r.t, r.t, 1]
    if state.hasTimedOut and current:
        out.append((key[0], *current))
        state.remove()
    elif current:
        state.update(tuple(current))
        state.setTimeoutTimestamp(int(current[2] * 1000) + 86_400_000)
    yield pd.DataFrame(out, columns=["user_id", "state", "first_t", "last_t", "n"])


def state_runs(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Closed runs of equal states (user_id, event_id, ts, state), one row when the next run starts or time passes on.

    A user's state is one open run, whatever the length of the stream.
    """
    timed = events.withWatermark("ts", late).withColumn("t", F.unix_micros("ts") / 1e6)
    return timed.groupBy("user_id").applyInPandasWithState(_runs, RUN, "state string, first_t double, last_t double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def suppressed_sessions(peaks: DataFrame, suppression: float, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Peaks (user_id, event_id, ts, value) that stay after greedy suppression in each closed session.

    A session ends after ``gap`` without a peak. Where ``gap`` is at least as long as
    ``suppression`` seconds no peak can suppress one of another session, so the result
    is that of the batch operator.
    """
    timed = peaks.withWatermark("ts", late).withColumn("t", F.unix_micros("ts") / 1e6)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("s"), F.col("event_id").alias("i"), "t")))
    closed = timed.groupBy(F.session_window("ts", gap), "user_id").agg(ordered.alias("p"))
    return closed.select("user_id", F.explode(kept(F.col("p"), suppression)).alias("k")).select("user_id", F.col("k.i").alias("event_id"), "k.t", (-F.col("k.s")).alias("value"))


TRACKED = "rec long, t double, box_id long, track int"


def live_tracks(boxes: DataFrame, most_gap: float, least: float = 0.1, bonus: float = 0.2, late: str = "10 seconds") -> DataFrame:
    """``rec, t, box_id, track`` of boxes (rec, ts, t, box_id, label, x0..y1) that come in order of frames.

    A recording's state is its live tracks; those unseen for ``most_gap`` are dropped
    with the next frame, and all of them once time has passed on by as much.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live, fresh = json.loads(state.get[0]) if state.exists else [{}, 0]
        live = {int(k): (tuple(v[0]), v[1], v[2]) for k, v in live.items()}
        if state.hasTimedOut:
            state.update((json.dumps([{}, fresh]),))
            return
        out, last = [], 0.0
        for when, found in tracks.frames_of(pd.concat(list(batches)), "t"):
            live, fresh, told = tracks.associate(live, fresh, when, found, most_gap, least, bonus)
            out += [(key[0], when, b[0], k) for b, k in zip(found, told)]
            last = when
        state.update((json.dumps([live, fresh]),))
        state.setTimeoutTimestamp(max(int((last + most_gap) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["rec", "t", "box_id", "track"])

    timed = boxes.withWatermark("ts", late)
    return timed.groupBy("rec").applyInPandasWithState(run, TRACKED, "live string", "append", GroupStateTimeout.EventTimeTimeout)


def write_once(stream: DataFrame, path: str, key: str, checkpoint: str):
    """A query that appends rows whose key the output lacks: a batch that is replayed adds nothing."""
    from ..sources.sinks import append_pending

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_pending(batch.dropDuplicates([key]), path, key) and None)
