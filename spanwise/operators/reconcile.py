"""Labels from several sources: resolution by precedence, conflicts, upserts, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve(claims: DataFrame, keys: list[str], rank: str, value: str, unknown: str = "UNKNOWN") -> DataFrame:
    """The last known value by source rank, how many sources claim, and whether they disagree."""
    known = F.col(value).isNotNull() & (F.col(value) != unknown)
    return claims.groupBy(*keys).agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.col(rank))).alias("resolved"), F.count_if(known).alias("claims"), (F.count_distinct(F.when(known, F.col(value))) > 1).alias("conflict"))


def deduplicated(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(rows: DataFrame, corrections: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with corrected values where there is one, ``before`` and whether it ``changed``."""
    c = corrections.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    joined = rows.join(c, F.col(key) == F.col("__k"), "left")
    return joined.withColumn("before", F.col(value)).withColumn(value, F.coalesce("__v", value)).withColumn("changed", ~F.col("before").eqNullSafe(F.col(value))).drop("__k", "__v")


def unanimous(votes: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """Keys that at least ``least`` votes agree on without exception."""
    return votes.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__x"), F.count(value).alias("__n")).where((F.col(value) == F.col("__x")) & (F.col("__n") >= least)).drop("__x", "__n")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def conflicts(sources: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Keys for which files hold different contents."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return sources.groupBy(key).agg(F.count_distinct(digest).alias("versions")).where("versions > 1")


def first_wins(sources: DataFrame, key: str, rank: str) -> DataFrame:
    return deduplicated(sources, [key], [F.col(rank)])


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raise if a recording is on both sides of a split."""
    both = a.select(key).intersect(b.select(key)).limit(5).collect()
    if both:
        raise ValueError(f"on both sides of the split: {[r[0] for r in both]}")


def excluded(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not used before; an exclusion list that matches nothing is an error."""
    if rows.join(used.select(key).distinct(), key, "left_semi").isEmpty():
        raise ValueError("the exclusion list matches no row")
    return rows.join(used.select(key).distinct(), key, "left_anti")
