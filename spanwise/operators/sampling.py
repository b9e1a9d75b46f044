"""Deterministic samples: every draw is an order by a hash, so that a rerun gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import numbered


def draw(key: str, a: int = 7919, b: int = 1009) -> Column:
    """A portable pseudo-random number of an integer key: the same in any SQL engine."""
    return F.col(key) * a % b


def round_robin(rows: DataFrame, group: str, key: str, cap: int, n: int) -> DataFrame:
    """Depth first across groups: everyone's first draw, then everyone's second, ... at most ``cap`` each and ``n`` in all."""
    depth = F.row_number().over(W.partitionBy(group).orderBy(draw(key), key))
    return rows.withColumn("depth", depth).where(F.col("depth") <= cap).orderBy("depth", group).limit(n)


def per_group(rows: DataFrame, groups: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each group in the given order."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("__r") <= cap).drop("__r")


def grouped_folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """A fold for each group, groups dealt out one by one in the order of their draws."""
    g = numbered(rows.select(group).distinct(), F.crc32(F.col(group).cast("string")), group)
    return g.select(group, (F.col("place") % k).cast("int").alias("fold"))


def serpentine_folds(rows: DataFrame, group: str, y: str, k: int) -> DataFrame:
    """Folds that balance the positive rate: groups by rate, dealt there and back."""
    g = numbered(rows.groupBy(group).agg(F.round(F.avg(y), 9).alias("rate")), F.col("rate").desc(), group)
    i = F.col("place")
    lap = F.floor(i / k)
    return g.withColumn("fold", F.when(lap % 2 == 0, i % k).otherwise(k - 1 - i % k).cast("int")).select(group, "rate", "fold")


def quotas(rows: DataFrame, cell: str, n: int) -> DataFrame:
    """Per cell one place and a share of the rest in proportion: ``cell, size, quota``."""
    c = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("size"))
    total = c.agg(F.sum("size").alias("all"), F.count(F.lit(1)).alias("cells"))
    rest = F.greatest(F.lit(n) - F.col("cells"), F.lit(0))
    return c.join(F.broadcast(total)).select(cell, "size", F.least(F.col("size"), 1 + F.bround(rest * F.col("size") / F.col("all"), 0).cast("long")).alias("quota"))


def spread(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """``k`` rows of each group, evenly through its order, first and last included."""
    w = W.partitionBy(group)
    numbered = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("__n") - 1) / max(1, k - 1), 0).cast("int"))
    return numbered.where(F.array_contains(wanted, F.col("__i"))).drop("__i", "__n")


def in_turn(rows: DataFrame, wants: list[tuple[str, Column, int]], group: str, key: str, cap: int) -> DataFrame:
    """Samples of several strata one after another: no row twice, at most ``cap`` of a group over all strata.

    Each stratum is one distributed pass over what the ones before left.
    """
    taken = None
    for name, test, n in wants:
        left = rows.where(test)
        if taken is not None:
            left = left.join(taken.select(key), key, "left_anti").join(taken.groupBy(group).agg(F.count(F.lit(1)).alias("__used")), group, "left")
        else:
            left = left.withColumn("__used", F.lit(0))
        depth = F.row_number().over(W.partitionBy(group).orderBy(draw(key), key)) + F.coalesce("__used", F.lit(0))
        got = left.withColumn("__d", depth).where(F.col("__d") <= cap).orderBy(draw(key), key).limit(n).drop("__d", "__used").withColumn("stratum", F.lit(name))
        taken = got if taken is None else taken.unionByName(got)
    return taken
