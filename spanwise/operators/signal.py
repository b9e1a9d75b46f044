"""Decoding of score curves: local maxima, suppression, top-k, runs, gaps and smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def local_maxima(curve: DataFrame, keys: list[str], order: list[str], score: str) -> DataFrame:
    """Rows not below either neighbour; ends count with the one they have, and plateaus whole."""
    w = W.partitionBy(*keys).orderBy(*order)
    before, after = F.lag(score).over(w), F.lead(score).over(w)
    return curve.withColumn("__up", before.isNull() | (F.col(score) >= before)).withColumn("__down", after.isNull() | (F.col(score) >= after)).where("__up and __down").drop("__up", "__down")


def kept(peaks: Column, gap: float, k: Column | None = None) -> Column:
    """Fold over peaks in order of score: one stays if it is ``gap`` from all that stay, until there are ``k``."""

    def step(kept, p):
        free = F.forall(kept, lambda q: F.abs(q["t"] - p["t"]) >= gap)
        room = F.lit(True) if k is None else F.size(kept) < k
        return F.when(free & room, F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(peaks, F.filter(peaks, lambda _: F.lit(False)), step)


def pieces(peaks: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """``peaks`` with ``__piece``: a group's peaks cut where none is within ``gap``; no peak suppresses one of another piece."""
    w = W.partitionBy(*keys).orderBy(t)
    apart = F.coalesce(F.col(t) - F.lag(t).over(w) >= gap, F.lit(True))
    return peaks.withColumn("__apart", apart.cast("long")).withColumn("__piece", F.sum("__apart").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__apart")


def suppress(peaks: DataFrame, keys: list[str], t: str, i: str, score: str, gap: float, k: Column | None = None) -> DataFrame:
    """Greedy non-maximum suppression per group, by falling score and rising index; ``k``: at most so many, an aggregate's column.

    Without ``k`` the fold runs over pieces of a group that cannot reach each other.
    """
    by = [*keys, "__piece"] if k is None else keys
    peaks = pieces(peaks, keys, t, gap) if k is None else peaks
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(i).cast("long").alias("i"), F.col(t).cast("double").alias("t"))))
    grouped = peaks.groupBy(*by).agg(ordered.alias("__p"), *([k.alias("__k")] if k is not None else []))
    done = grouped.withColumn("__kept", kept(F.col("__p"), gap, F.col("__k") if k is not None else None))
    return done.select(*keys, F.explode("__kept").alias("p")).select(*keys, F.col("p.i").alias("i"), F.col("p.t").alias("t"), (-F.col("p.s")).alias("score"))


def with_quantile(rows: DataFrame, keys: list[str], x: str, q: float, name: str) -> DataFrame:
    """``rows`` with ``name``: the ``q``-quantile of ``x``, which is not null, in their group, on the line between two neighbours in order.

    Between ``a`` and ``b`` it is ``a * (1 - d) + b * d`` with one rounding of the first
    product and the sum, as SQL's ``quantile_cont`` has it: neighbours that differ in the
    last bit only are on one side of it here as there.
    """
    every = W.partitionBy(*keys)
    placed = rows.withColumns({"__at": F.row_number().over(every.orderBy(x)) - 1, "__pos": (F.count(F.lit(1)).over(every) - 1) * F.lit(float(q))})
    of = lambda at: F.max(F.when(F.col("__at") == at(F.col("__pos")), F.col(x))).over(every)
    held = placed.withColumns({"__a": of(F.floor), "__b": of(F.ceil), "__d": F.col("__pos") - F.floor("__pos")})
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.col("__a"), 1 - F.col("__d"), F.col("__b") * F.col("__d")).cast("double")
    return held.withColumn(name, F.when(F.col("__d") > 0, fused).otherwise(F.col("__a"))).drop("__at", "__pos", "__a", "__b", "__d")


def suppressors(peaks: DataFrame, keys: list[str], t: str, i: str, score: str, gap: float) -> DataFrame:
    """Every peak with whether it stays, and the first kept peak, in the order of keeping, that blocks it."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(i).cast("long").alias("i"), F.col(t).cast("double").alias("t"))))
    grouped = pieces(peaks, keys, t, gap).groupBy(*keys, "__piece").agg(ordered.alias("__p")).withColumn("__kept", kept(F.col("__p"), gap))
    each = grouped.select(*keys, "__kept", F.explode("__p").alias("p"))
    blocker = F.element_at(F.filter("__kept", lambda q: F.abs(q["t"] - F.col("p.t")) < gap), 1)
    own = F.exists("__kept", lambda q: q["i"] == F.col("p.i"))
    return each.select(*keys, F.col("p.i").alias("i"), own.alias("kept"), F.when(~own, F.try_element_at(F.transform(F.filter("__kept", lambda q: F.abs(q["t"] - F.col("p.t")) < gap), lambda q: q["i"]), F.lit(1))).alias("blocker"))


def runs(states: DataFrame, keys: list[str], order: list[str], state: str, t: str) -> DataFrame:
    """Runs of equal states, in which a null breaks a run: state, first and last time, length."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.col(state).isNotNull() & ~F.coalesce(F.lag(state).over(w) == F.col(state), F.lit(False))
    return states.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(w)).where(F.col(state).isNotNull()).groupBy(*keys, "run", state).agg(F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.count(F.lit(1)).alias("n"))


def fill_gaps(series: DataFrame, keys: list[str], t: str, x: str, most: float) -> DataFrame:
    """Missing values between two known ones at most ``most`` apart are filled on the line; nothing beyond the ends."""
    known = F.when(F.col(x).isNotNull(), F.struct(F.col(t).alias("t"), F.col(x).alias("x")))
    w = W.partitionBy(*keys).orderBy(t)
    out = series.withColumn("__a", F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    line = F.col("__a.x") + (F.col("__b.x") - F.col("__a.x")) * (F.col(t) - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t"))
    can = F.col(x).isNull() & (F.col("__b.t") - F.col("__a.t") <= most)
    return out.withColumn("filled", F.coalesce(can, F.lit(False))).withColumn(f"{x}_filled", F.when(F.col(x).isNotNull(), F.col(x)).when(can, line)).drop("__a", "__b")


def smoothed(series: DataFrame, keys: list[str], order: list[str], x: str, k: int = 3) -> Column:
    """Moving average over k rows with zeros beyond the ends."""
    half = k // 2
    return F.sum(x).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)) / k


def gaps(series: DataFrame, keys: list[str], t: str) -> DataFrame:
    """The longest time between neighbours in each group."""
    step = F.col(t) - F.lag(t).over(W.partitionBy(*keys).orderBy(t))
    return series.withColumn("__s", step).groupBy(*keys).agg(F.max("__s").alias("longest_gap"))


def grid(bounds: DataFrame, lo: str, hi: str, step: float) -> DataFrame:
    """Evenly spaced times from ``lo`` on, ``step`` apart, up to ``hi``."""
    n = F.floor((F.col(hi) - F.col(lo)) / step)
    return bounds.withColumn("k", F.explode(F.sequence(F.lit(0), n.cast("int")))).withColumn("grid_t", F.col(lo) + F.col("k") * step)
