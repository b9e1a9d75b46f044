"""Numbers of rows in an order, by ranges of it: no task orders all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import settled


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` with ``place``, their number in the given order, from 0."""
    # ids grow along the sorted partitions, which are written once; sums of their sizes make them dense
    ordered = settled(rows.sort(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("part", "n")).alias("__sizes"))  # a number a partition
    before = F.aggregate(F.filter("__sizes", lambda s: s["part"] < part), F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    return ordered.join(F.broadcast(sizes)).withColumn("place", before + inside).drop("__id", "__sizes")


def sums_before(rows: DataFrame, order: str, x: str) -> DataFrame:
    """``rows`` with ``before``: the sum of the whole number ``x`` over all rows before each, in order of ``order``; within ranges, with the sums of ranges before."""
    ordered = settled(rows.sort(order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)))
    sums = ordered.groupBy("__part").agg(F.sum(x).alias("s")).agg(F.collect_list(F.struct("__part", "s")).alias("__sums"))  # a number a partition
    earlier = F.aggregate(F.filter("__sums", lambda p: p["__part"] < F.col("__part")), F.lit(0).cast("long"), lambda acc, p: acc + p["s"])
    within = F.sum(x).over(W.partitionBy("__part").orderBy("__id")) - F.col(x)
    return ordered.join(F.broadcast(sums)).withColumn("before", earlier + within).drop("__id", "__part", "__sums")
