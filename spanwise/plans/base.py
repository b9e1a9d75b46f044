"""Concepts that the queries share, on the supplied tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table

#: Microseconds of the first day of the events.
EPOCH = 1704067200000000
HOUR = 3600.0
TOL, GAP = 6 * HOUR, 12 * HOUR


def curve(spark: SparkSession, d: str) -> DataFrame:
    """Score curve of each recording (user): ``user_id, i, t, prob, label``; time in seconds."""
    e = table(spark, d, "events")
    return e.select("user_id", F.col("event_id").alias("i"), ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6).alias("t"), F.col("value").alias("prob"), F.col("event_type").alias("label"))


CURVE = f"curve AS (SELECT user_id, event_id AS i, (epoch_us(ts) - {EPOCH}) / 1e6 AS t, value AS prob, event_type AS label FROM events)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments between consecutive events: ``user_id, seg, label, s, e``."""
    w = W.partitionBy("user_id").orderBy("t", "i")
    return curve(spark, d).withColumn("e", F.lead("t").over(w)).withColumn("seg", F.row_number().over(w).cast("long")).where("e IS NOT NULL").select("user_id", "seg", "label", F.col("t").alias("s"), "e")


SEGMENTS = f"{CURVE}, segments AS (SELECT user_id, seg, label, t AS s, e FROM (SELECT *, lead(t) OVER w AS e, CAST(row_number() OVER w AS BIGINT) AS seg FROM curve WINDOW w AS (PARTITION BY user_id ORDER BY t, i)) q WHERE e IS NOT NULL)"


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Boundary times: purchases."""
    return curve(spark, d).where("label = 'purchase'").select("user_id", F.col("i").alias("g"), F.col("t").alias("u"))


TRUTH = "truth AS (SELECT user_id, i AS g, t AS u FROM curve WHERE label = 'purchase')"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled items with two scores: ``doc_id, source, lang, y, z, s, s2``."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", "lang", F.col("quality").alias("y"), F.col("toxic").alias("z"), F.round((F.col("n_chars") % 997) / 997, 2).alias("s"), ((F.col("doc_id") * 7919 % 1009) / 1009).alias("s2"))


SCORED = "scored AS (SELECT doc_id, source, lang, quality AS y, toxic AS z, round((n_chars % 997) / CAST(997 AS DOUBLE), 2) AS s, (doc_id * 7919 % 1009) / CAST(1009 AS DOUBLE) AS s2 FROM documents JOIN labels USING (doc_id))"


def r6(c: Column | str) -> Column:
    """Six decimals, which hides the order of summation."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


class Book:
    """Queries and their SQL, under the ids of the inventory."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return keep
