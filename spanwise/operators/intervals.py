"""Joins on time within a recording: tolerance, nearest, containing, previous and next.

Points and segments are dealt into buckets of time, so that a join compares those of
neighbouring buckets only, whatever the length of a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tolerance_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, u: str, tol: float, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal ``keys`` and times ``t`` (left) and ``u`` (right) at most ``tol`` apart.

    ``how``: inner or left. The equality on the bucket turns the range condition into
    a hash or sort-merge join; each right row is in three buckets.
    """
    a = left.withColumn("__left", F.floor(F.col(t) / tol))
    b = right.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__right", F.explode(F.array(*[F.floor(F.col(u) / tol) + d for d in (-1, 0, 1)])))
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__left") == F.col("__right"), F.abs(F.col(t) - F.col(u)) <= tol]
    return a.join(b, on, how).drop("__left", "__right", *[f"__{k}" for k in keys])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, u: str, row: list[str], columns: list[str], tol: float | None = None) -> DataFrame:
    """``left`` with ``columns`` of the right row nearest in time, the earlier of two as near.

    ``row`` identifies a left row. Without ``tol`` the search is unbounded: the last
    right row at or before and the first one after are found in one ordered pass.
    """
    value = F.struct(F.col(u).alias("u"), *columns)
    both = left.select(*keys, *row, F.col(t).alias("__t"), F.lit(1).alias("__left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__v")).unionByName(right.select(*keys, F.col(u).alias("__t"), F.lit(0).alias("__left"), value.alias("__v")), allowMissingColumns=True)
    back = W.partitionBy(*keys).orderBy("__t", "__left").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy("__t", F.col("__left").desc()).rowsBetween(0, W.unboundedFollowing)
    seen = both.withColumn("__p", F.last("__v", ignorenulls=True).over(back)).withColumn("__n", F.first("__v", ignorenulls=True).over(ahead)).where("__left = 1")
    before, after = F.col("__t") - F.col("__p.u"), F.col("__n.u") - F.col("__t")
    best = F.when(F.col("__n").isNull() | (before <= after), F.col("__p")).otherwise(F.col("__n"))
    out = seen.withColumn("__m", best).withColumn("distance", F.abs(F.col("__t") - F.col("__m.u")))
    if tol is not None:
        far = F.col("distance") > tol
        out = out.withColumn("__m", F.when(~far, F.col("__m"))).withColumn("distance", F.when(~far, F.col("distance")))
    return out.select(*keys, *row, F.col("__t").alias(t), F.col("__m.u").alias(f"{u}_nearest"), *[F.col(f"__m.{c}").alias(c) for c in columns], "distance")


def best_within(left: DataFrame, right: DataFrame, keys: list[str], t: str, u: str, width: float, score: str, row: list[str]) -> DataFrame:
    """For each left row the right row of highest ``score`` within ``width``, the earliest of ties; null if there is none."""
    pairs = tolerance_join(left, right, keys, t, u, width, "left")
    return pairs.groupBy(*keys, *row, t).agg(F.max(score).alias("best_score"), F.min_by(F.col(u), F.struct(-F.col(score), F.col(u))).alias("best_t"))


def containing_all(points: DataFrame, segments: DataFrame, keys: list[str], t: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Each point with every segment that holds it, both ends included.

    ``width``: size of the buckets; a segment is in as many as it reaches into.
    """
    p = points.withColumn("__left", F.floor(F.col(t) / width))
    others = [c for c in segments.columns if c not in keys]
    s = segments.select(*[F.col(k).alias(f"__{k}") for k in keys], *others).withColumn("__right", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__left") == F.col("__right"), F.col(t) >= F.col(start), F.col(t) <= F.col(end)]
    return p.join(s, on, how).drop("__left", "__right", *[f"__{k}" for k in keys])


def containing(points: DataFrame, segments: DataFrame, keys: list[str], t: str, start: str, end: str, row: list[str], columns: list[str], width: float) -> DataFrame:
    """The first segment, by start, that holds each point, both ends included; null columns if none does."""
    joined = containing_all(points.select(*keys, *row, t), segments.select(*keys, start, end, *[c for c in columns if c not in (start, end)]), keys, t, start, end, width, "left")
    first = F.min_by(F.struct(*columns), F.struct(start, end))
    return joined.groupBy(*keys, *row, t).agg(first.alias("__s")).select(*keys, *row, t, *[F.col(f"__s.{c}").alias(c) for c in columns])


def previous_next(points: DataFrame, segments: DataFrame, keys: list[str], t: str, start: str, end: str, row: list[str], label: str) -> DataFrame:
    """The label of the last segment that ends, and of the first that starts, at or before and after each point."""
    null = F.lit(None).cast("string")
    left = points.select(*keys, *row, F.col(t).alias("__t"), F.lit(1).alias("__k"), null.alias("__l"))
    ends = segments.select(*keys, F.col(end).alias("__t"), F.lit(0).alias("__k"), F.col(label).alias("__l"))
    starts = segments.select(*keys, F.col(start).alias("__t"), F.lit(2).alias("__k"), F.col(label).alias("__l"))
    both = left.unionByName(ends, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    w = W.partitionBy(*keys)
    of = lambda k: F.when(F.col("__k") == k, F.col("__l"))
    seen = both.withColumn("previous_label", F.last(of(0), ignorenulls=True).over(w.orderBy("__t", "__k", "__l").rowsBetween(W.unboundedPreceding, 0))).withColumn("next_label", F.first(of(2), ignorenulls=True).over(w.orderBy("__t", "__k", "__l").rowsBetween(0, W.unboundedFollowing)))
    return seen.where("__k = 1").select(*keys, *row, F.col("__t").alias(t), "previous_label", "next_label")


def adjacent(segments: DataFrame, keys: list[str], start: str, end: str, label: str, most_gap: float, most_span: float) -> DataFrame:
    """Each segment with the one after it, where gap and span allow and the labels differ."""
    w = W.partitionBy(*keys).orderBy(start, end)
    nxt = segments.withColumn("next_label", F.lead(label).over(w)).withColumn("next_start", F.lead(start).over(w)).withColumn("next_end", F.lead(end).over(w))
    return nxt.where((F.col("next_start") - F.col(end) <= most_gap) & (F.col("next_end") - F.col(start) <= most_span) & (F.col("next_label") != F.col(label)))


def associate(anchors: DataFrame, points: DataFrame, keys: list[str], t: str, u: str, row: list[str], width: float, tol: float) -> DataFrame:
    """Points near each anchor, ranked: the nearest is ALIGNED, EARLY or LATE, the others DUPLICATE."""
    pairs = tolerance_join(anchors, points, keys, t, u, width)
    d = F.col(u) - F.col(t)
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy(*keys, *row).orderBy(F.abs(d), u)))
    status = F.when(F.col("rank") > 1, "DUPLICATE").when(F.abs(d) <= tol, "ALIGNED").when(d < 0, "EARLY").otherwise("LATE")
    return ranked.withColumn("offset", d).withColumn("status", status)


def covered(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per group the length of the union of spans, the sum of lengths, and what they share."""
    so_far = F.max(end).over(W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(so_far, F.col(start))), F.lit(0.0))
    return spans.withColumn("__fresh", fresh).groupBy(*keys).agg(F.sum("__fresh").alias("covered"), F.sum(F.col(end) - F.col(start)).alias("total")).withColumn("shared", F.col("total") - F.col("covered"))


def neighbour_bounds(points: DataFrame, edges: DataFrame, keys: list[str], t: str, e: str, row: list[str]) -> DataFrame:
    """The nearest edges below and above each point, at least a microsecond away."""
    null = F.lit(None).cast("double")
    both = points.select(*keys, *row, F.col(t).alias("__t"), F.lit(True).alias("__p"), null.alias("__e")).unionByName(edges.select(*keys, F.col(e).alias("__t"), F.lit(False).alias("__p"), F.col(e).alias("__e")), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("__m")
    micros = both.withColumn("__m", F.round(F.col("__t") * 1e6).cast("long"))
    seen = micros.withColumn("low", F.max("__e").over(w.rangeBetween(W.unboundedPreceding, -1))).withColumn("high", F.min("__e").over(w.rangeBetween(1, W.unboundedFollowing)))
    return seen.where("__p").select(*keys, *row, F.col("__t").alias(t), "low", "high")


def fuzzy_match(left: DataFrame, right: DataFrame, keys: list[str], t: str, u: str, row: list[str], exact: float, loose: float, ratio: float) -> DataFrame:
    """Right time for each left row: within ``exact``, or within ``loose`` if the next nearest is over ``ratio`` times as far.

    Times on the right beyond ``loose`` times ``ratio`` change nothing: only those within are joined.
    """
    reach = max(exact, loose, loose * ratio)
    near = tolerance_join(left.select(*keys, *row, t), right.select(*keys, u), keys, t, u, reach).withColumn("__d", F.abs(F.col(t) - F.col(u)))
    near = near.withColumn("__r", F.row_number().over(W.partitionBy(*keys, *row, t).orderBy("__d", u))).where("__r <= 2")
    one = near.groupBy(*keys, *row, t).agg(F.min(F.when(F.col("__r") == 1, F.col("__d"))).alias("d1"), F.min(F.when(F.col("__r") == 2, F.col("__d"))).alias("d2"), F.min(F.when(F.col("__r") == 1, F.col(u))).alias("match"))
    ok = (F.col("d1") <= exact) | ((F.col("d1") <= loose) & (F.col("d2").isNull() | (F.col("d2") > ratio * F.col("d1"))))
    return one.where(ok).select(*keys, *row, t, "match", "d1")
