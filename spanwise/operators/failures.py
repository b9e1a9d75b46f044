"""Where decoded peaks fail: boundaries missed between equal and different names, false peaks within segments, outlier recordings, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals, matching

#: Shares of a segment from its ends that count as its edge, examples of a recording and of a kind, and recordings listed.
EDGE, PER_RECORDING, EXAMPLES, TOP = 0.15, 2, 12, 5
NONE = "?"


def boundaries(segments: DataFrame, key: str) -> DataFrame:
    """``key, u, before, after``: the starts of segments (key, label, s, e) but a recording's first, with the label of the one that ends there (``?``: none does)."""
    w = W.partitionBy(key).orderBy("s", "e")
    every = segments.withColumns({"__first": F.row_number().over(w) == 1, "__end": F.lag("e").over(w), "__label": F.lag("label").over(w)})
    before = F.when(F.round("__end", 2) == F.round("s", 2), F.col("__label")).otherwise(NONE)
    return every.where(~F.col("__first")).select(key, F.col("s").alias("u"), before.alias("before"), F.col("label").alias("after"))


def missed(peaks: DataFrame, bounds: DataFrame, key: str, t: str, tol: float) -> DataFrame:
    """``bounds`` with ``kind`` (same or diff names) and ``missed``: no peak, in order of time, took it within ``tol``.

    A recording's times are cut where nothing could match across.
    """
    cut = matching.pieces(peaks, bounds.withColumnRenamed("u", t), [key], t, tol)
    left = cut.select(key, F.explode(matching.unmatched_in_order(F.col("__p"), F.col("__g"), tol)).alias("u")).groupBy(key, "u").agg(F.count(F.lit(1)).alias("__n"))
    # boundaries at one time: as many are missed as are left, the last ones
    nth = F.row_number().over(W.partitionBy(key, "u").orderBy(F.desc("before"), F.desc("after")))
    told = bounds.withColumn("__k", nth).join(left, [key, "u"], "left")
    return told.withColumns({"kind": F.when(F.col("before") == F.col("after"), "same").otherwise("diff"), "missed": F.coalesce(F.col("__k") <= F.col("__n"), F.lit(False))}).drop("__k", "__n")


def false_peaks(peaks: DataFrame, bounds: DataFrame, segments: DataFrame, key: str, t: str, row: str, tol: float, width: float) -> DataFrame:
    """Peaks with no boundary within ``tol``: ``key, row, t, name, place``: the first segment that holds each and how far into it (``<gap>`` and null: none does). ``width``: about a segment's length."""
    far = intervals.tolerance_join(peaks.select(key, row, t), bounds.select(key, "u"), [key], t, "u", tol, "left").groupBy(key, row, t).agg(F.count("u").alias("__n")).where("__n = 0").drop("__n")
    held = intervals.containing(far, segments, [key], t, "s", "e", [row], ["s", "e", "label"], width)
    place = (F.col(t) - F.col("s")) / F.greatest(F.col("e") - F.col("s"), F.lit(1e-6))
    name = F.when(F.col("s").isNull(), "<gap>").otherwise(F.col("label"))
    return held.select(key, row, t, name.alias("name"), F.when(F.col("s").isNotNull(), place).alias("place"))


def examples(rows: DataFrame, key: str, kind: Column, order: str) -> DataFrame:
    """At most ``PER_RECORDING`` rows of a recording and kind, and ``EXAMPLES`` of a kind, in order of recording and time."""
    own = rows.withColumn("__kind", kind).withColumn("__r", F.row_number().over(W.partitionBy("__kind", key).orderBy(order))).where(F.col("__r") <= PER_RECORDING)
    return own.withColumn("__k", F.row_number().over(W.partitionBy("__kind").orderBy(key, order))).where(F.col("__k") <= EXAMPLES).drop("__kind", "__r", "__k")


def audit(peaks: DataFrame, segments: DataFrame, key: str, t: str, row: str, tol: float, width: float) -> DataFrame:
    """``part, name, n, of, value``, whole.

    ``rate``: missed of all boundaries by kind. ``position``: of false peaks in a
    segment the ``mean`` and ``median`` place, and how many are at an ``edge``.
    ``missed_top``, ``false_top``: the recordings with most of them. ``missed_same``,
    ``missed_diff``, ``false``: examples, ``name`` the recording, ``value`` the time.
    """
    bounds = boundaries(segments, key)
    told = missed(peaks, bounds, key, t, tol)
    false = false_peaks(peaks, bounds, segments, key, t, row, tol, width)
    count, none = F.count(F.lit(1)), F.lit(None).cast("double")

    def line(part: Column | str, name, n, of, value) -> list[Column]:
        return [(F.lit(part) if isinstance(part, str) else part).alias("part"), name.cast("string").alias("name"), n.cast("long").alias("n"), of.cast("long").alias("of"), value.cast("double").alias("value")]

    rate = told.groupBy("kind").agg(F.count_if("missed").alias("n"), count.alias("of")).select(*line("rate", F.col("kind"), F.col("n"), F.col("of"), F.col("n") / F.col("of")))
    inside = false.where("place IS NOT NULL").agg(count.alias("of"), F.avg("place").alias("mean"), F.percentile("place", 0.5).alias("median"), F.count_if((F.col("place") < EDGE) | (F.col("place") > 1 - EDGE)).alias("edge"))
    places = [inside.select(*line("position", F.lit(c), F.col("of"), F.col("of"), F.col(c))) for c in ("mean", "median")] + [inside.select(*line("position", F.lit("edge"), F.col("edge"), F.col("of"), F.col("edge") / F.when(F.col("of") > 0, F.col("of"))))]

    def top(rows: DataFrame, part: str) -> DataFrame:
        by = rows.groupBy(key).agg(count.alias("n"))
        most = by.orderBy(F.desc("n"), key).limit(TOP)
        return most.join(F.broadcast(by.agg(F.sum("n").alias("of")))).select(*line(part, F.col(key), F.col("n"), F.col("of"), F.col("n") / F.col("of")))  # one row

    lost = told.where("missed")
    shown = [
        examples(lost, key, F.col("kind"), "u").select(*line(F.concat(F.lit("missed_"), "kind"), F.col(key), none, none, F.col("u"))),
        examples(false, key, F.lit("false"), t).select(*line("false", F.col(key), none, none, F.col(t))),
    ]
    out = rate
    for part in [*places, top(lost, "missed_top"), top(false, "false_top"), *shown]:
        out = out.unionByName(part)
    return out
