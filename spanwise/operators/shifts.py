"""Shift nulls: how often peaks would fall near boundaries if their times meant nothing.

In a circular shift all peaks of a recording move together, modulo its span; in the
other null each peak has a shift of its own. Instead of replicates of rows, the times
of a recording are held sorted, and a shift is a lookup: the shifts at which some peak
hits a boundary are those that bring the boundary, moved back, upon a peak. So rows are shuffled
once, however many replicates there are; tasks return a count a replicate.

Times of a recording are dealt into blocks of about ``BLOCK``. A block of what is
counted meets the blocks of the other side one after another, and a hit with any of
them counts once, so a recording of any size is held a block at a time.

Boundaries may be intervals; a time inside is at distance 0. Rows without a time, and
recordings without a span, are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Times of a block, about, and replicates that are looked up at once.
BLOCK, AT_ONCE = 4096, 128
#: Shifts are multiples of a span's part of this size.
STEPS = 100_003


def together(b: np.ndarray, key: int) -> np.ndarray:
    """The part of its span by which a recording moves in each replicate."""
    return (b * 104_729 + key * 7_919 + 1) % STEPS / float(STEPS)


def alone(b: int, row: np.ndarray) -> np.ndarray:
    """The part of its span by which each peak moves in a replicate."""
    return (b * 104_729 + row * 7_919) % STEPS / float(STEPS)


def as_they_are(lo: np.ndarray, hi: np.ndarray, times: np.ndarray, tol: float) -> np.ndarray:
    """Whether any of the sorted ``times`` is within ``tol`` of each interval."""
    at = np.searchsorted(times, lo)
    padded = np.concatenate([[-np.inf], times, [np.inf]])
    return (np.maximum(padded[at + 1] - hi, 0) <= tol) | (lo - padded[at] <= tol)


def near_boundaries(lo, hi, times, start, span, tol, part) -> np.ndarray:
    """A row a replicate: whether a peak, moved by ``part`` of the span, is within ``tol`` of each boundary ``lo`` to ``hi``."""
    x, y = np.maximum(start, lo - tol), np.minimum(start + span, hi + tol)
    # the boundary's window moved back is where a peak must have been; it may go on past the end
    a = start + np.mod(x - start - part[:, None] * span, span)
    end = a + (y - x)
    at = np.minimum(np.searchsorted(times, a), len(times) - 1)
    return (times[at] >= a) & (times[at] <= end) | (end - span >= times[0])


def near_peaks(t, lo, hi, start, span, tol, part) -> np.ndarray:
    """A row a replicate: whether each peak, moved, is within ``tol`` of any boundary (sorted by ``lo``)."""
    moved = start + np.mod(t - start + part[:, None] * span, span)
    at = np.searchsorted(lo - tol, moved, "right")
    reach = np.concatenate([[-np.inf], np.maximum.accumulate(hi + tol)])
    return reach[at] >= moved


def _stream(replicates: int, told: Callable):
    """Rows in order of (key, block) to ``b, hits``: ``told(row, b)`` says for a row and replicates what is hit; -1 is the row as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(replicates + 1, np.int64)
        at, weight, hit = None, None, None

        def close():
            if hit is not None:
                total[:] += hit @ weight

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                here = (row["key"].as_py(), row["block"].as_py())
                row = {c: np.asarray(v.values) if isinstance(v, pa.ListScalar) else v.as_py() for c, v in row.items()}
                if here != at:
                    close()
                    at, weight = here, row["m"]
                    hit = np.zeros((replicates + 1, len(weight)), bool)
                hit[0] |= told(row, None)
                for b in range(0, replicates, AT_ONCE):
                    drawn = np.arange(b, min(b + AT_ONCE, replicates), dtype=np.int64)
                    hit[b + 1 : b + 1 + len(drawn)] |= told(row, drawn)
        close()
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, replicates)), pa.array(total)], names=["b", "hits"])

    return run


def _blocked(rows: DataFrame, spans: DataFrame, at: str, columns: list[str], name: str, by_time: bool = True) -> DataFrame:
    """``key, start, span, <name>_block`` and arrays of ``columns``, in order of the first, of each block of a recording's rows."""
    sized = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = rows.join(spans, "key").join(sized, "key")
    block = F.floor(F.least((F.col(at) - F.col("start")) / F.col("span"), F.lit(1 - 1e-9)) * F.col("blocks")) if by_time else F.pmod(F.xxhash64(*columns), F.col("blocks"))
    held = placed.groupBy("key", "start", "span", block.alias(f"{name}_block")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    return held.select("key", "start", "span", f"{name}_block", *[F.col(f"rows.{c}").alias(c) for c in columns])


def _counted(asked: DataFrame, others: DataFrame, replicates: int, told: Callable) -> DataFrame:
    met = asked.withColumnRenamed("asked_block", "block").join(others.drop("start", "span"), "key").drop("others_block")
    dealt = met.repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(_stream(replicates, told), "b long, hits long").groupBy("b").agg(F.sum("hits").alias("hits"))


def _sides(peaks: DataFrame, truth: DataFrame, spans: DataFrame, key: str, t: str, u: tuple[str, str]):
    spans = spans.where("span > 0").select(F.col(key).cast("long").alias("key"), F.col("lo").cast("double").alias("start"), F.col("span").cast("double").alias("span"))
    bounds = truth.select(F.col(key).cast("long").alias("key"), F.least(*u).cast("double").alias("lo"), F.greatest(*u).cast("double").alias("hi")).where("key IS NOT NULL AND lo IS NOT NULL AND NOT isnan(hi)")
    times = peaks.select(F.col(key).cast("long").alias("key"), F.col(t).cast("double").alias("t"), *([F.col("row")] if "row" in peaks.columns else [])).where("key IS NOT NULL AND t IS NOT NULL AND NOT isnan(t)")
    return times, bounds, spans


def every_replicate(counted: DataFrame, replicates: int, n: DataFrame) -> DataFrame:
    """``b, hits, n`` for every replicate and -1; 0 hits where nothing was counted. ``n`` is one row."""
    all_b = counted.sparkSession.range(-1, replicates).withColumnRenamed("id", "b")
    return all_b.join(counted, "b", "left").join(F.broadcast(n)).select("b", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "n")


def spans_of(*sides: DataFrame) -> DataFrame:
    """``key, lo, span`` of recordings, from ``key, time`` columns (the first two) of each."""
    every = None
    for s in sides:
        one = s.select(F.col(s.columns[0]).alias("k"), F.col(s.columns[1]).alias("x"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("k").agg(F.min("x").alias("lo"), (F.max("x") - F.min("x")).alias("span")).withColumnRenamed("k", sides[0].columns[0])


def circular(peaks: DataFrame, truth: DataFrame, spans: DataFrame, key: str, t: str, u: str | tuple[str, str], tol: float, replicates: int) -> tuple[DataFrame, DataFrame]:
    """Two tables ``b, hits, n``: boundaries with a peak within ``tol``, and peaks within ``tol`` of a boundary; replicate -1 is as it is.

    ``spans`` has ``lo`` and ``span`` of each recording. ``u`` is one column, or the ends
    of an interval. Equal times of a recording count once. Boundaries and peaks of recordings without a span are
    not counted; those of recordings without the other side count in ``n`` only.
    """
    times, bounds, spans = _sides(peaks, truth, spans, key, t, (u, u) if isinstance(u, str) else u)
    one = F.lit(1).cast("long").alias("m")
    times, bounds = times.select("key", "t").distinct(), bounds.distinct()
    n_bounds, n_times = (x.join(spans, "key").agg(F.count(F.lit(1)).alias("n")) for x in (bounds, times))

    def boundary(row, b):
        if b is None:
            return as_they_are(row["lo"], row["hi"], row["t"], tol)
        return near_boundaries(row["lo"], row["hi"], row["t"], row["start"], row["span"], tol, together(b, row["key"]))

    def peak(row, b):
        if b is None:
            # the distance of a time from intervals, those that begin after it and those before
            at = np.searchsorted(row["lo"], row["t"], "right")
            after = np.concatenate([row["lo"], [np.inf]])[at] - row["t"]
            before = row["t"] - np.concatenate([[-np.inf], np.maximum.accumulate(row["hi"])])[at]
            return np.minimum(after, before) <= tol
        return near_peaks(row["t"], row["lo"], row["hi"], row["start"], row["span"], tol, together(b, row["key"]))

    asked = _blocked(bounds.withColumn("m", one), spans, "lo", ["lo", "hi", "m"], "asked")
    hit_bounds = _counted(asked, _blocked(times, spans, "t", ["t"], "others"), replicates, boundary)
    asked = _blocked(times.withColumn("m", one), spans, "t", ["t", "m"], "asked")
    hit_times = _counted(asked, _blocked(bounds, spans, "lo", ["lo", "hi"], "others"), replicates, peak)
    return every_replicate(hit_bounds, replicates, n_bounds), every_replicate(hit_times, replicates, n_times)


def own_shifts(peaks: DataFrame, truth: DataFrame, spans: DataFrame, key: str, t: str, row: str, u: str | tuple[str, str], tol: float, replicates: int) -> DataFrame:
    """``b, hits, n``: boundaries with a peak within ``tol`` where each peak (numbered by ``row``) has a shift of its own; -1 is as it is.

    Boundaries that repeat count as often as they do.
    """
    times, bounds, spans = _sides(peaks.withColumn("row", F.col(row).cast("long")), truth, spans, key, t, (u, u) if isinstance(u, str) else u)
    bounds = bounds.groupBy("key", "lo", "hi").agg(F.count(F.lit(1)).alias("m"))
    n = bounds.join(spans, "key").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))

    def boundary(held, b):
        if b is None:
            return as_they_are(held["lo"], held["hi"], held["t"], tol)
        out = np.empty((len(b), len(held["lo"])), bool)
        for k, each in enumerate(b.tolist()):
            moved = held["start"] + np.mod(held["t"] - held["start"] + alone(each, held["row"]) * held["span"], held["span"])
            out[k] = as_they_are(held["lo"], held["hi"], np.sort(moved), tol)
        return out

    asked = _blocked(bounds, spans, "lo", ["lo", "hi", "m"], "asked")
    return every_replicate(_counted(asked, _blocked(times, spans, "t", ["t", "row"], "others", by_time=False), replicates, boundary), replicates, n)
