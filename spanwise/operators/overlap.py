"""Links between items whose word sets overlap, by a prefix join with length and position filters; exact at any threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a word that one block holds; words that more items have are dealt into blocks, of which every two meet.
MOST_ROWS = 4096


def overlap_links(items: DataFrame, keys: list[str], key: str, words: str, threshold: float, apart: str | None = None) -> DataFrame:
    """``keys, a, b, jaccard`` of every two items a < b of one group whose sets ``words`` have a Jaccard similarity of ``threshold`` or more.

    With ``apart`` items with equal values of this column are not linked. Items without
    words, or with null words, link with nothing. ``key`` is unique in a group.

    Each set is ordered by how few items of its group have a word. Two sets at the
    threshold share a word among all but the last ``ceil(t n) - 1`` of each; at the first
    word that they share, what is left of either set must still suffice. A word's rows
    are dealt into blocks, so no word is one task's work.
    """
    t = float(threshold)
    other = F.lit(None).cast("string") if apart is None else F.col(apart)
    sets = items.select(*keys, F.col(key).alias("__id"), F.array_distinct(F.filter(words, lambda w: w.isNotNull())).alias("__w"), other.alias("__apart")).where(F.size("__w") > 0)
    each = sets.select(*keys, "__id", "__apart", F.size("__w").alias("__n"), F.explode("__w").alias("__word"))
    df = each.groupBy(*keys, "__word").agg(F.count(F.lit(1)).alias("__df"))
    ranked = each.join(df, [*keys, "__word"]).withColumn("__at", F.row_number().over(W.partitionBy(*keys, "__id").orderBy("__df", "__word")))
    head = ranked.where(F.col("__at") <= F.col("__n") - F.ceil(t * F.col("__n") - 1e-9) + 1)
    blocks = F.ceil(F.col("__df") / MOST_ROWS).cast("int")
    head = head.withColumn("__blocks", blocks).withColumn("__block", F.pmod(F.xxhash64("__id"), F.col("__blocks")).cast("int"))

    def side(name: str, lo: Column, hi: Column, of: Column) -> DataFrame:
        return head.withColumn("__of", F.explode(of)).select(*keys, "__word", lo.alias("__lo"), hi.alias("__hi"), *[F.col(f"__{c}").alias(f"__{c}_{name}") for c in ("id", "n", "at", "apart")])

    mine, of = F.col("__block"), F.col("__of")
    left = side("a", mine, of, F.sequence(mine, F.col("__blocks") - 1))
    right = side("b", of, mine, F.sequence(F.lit(0), mine))
    na, nb = F.col("__n_a"), F.col("__n_b")
    long = (na >= t * nb - 1e-9) & (nb >= t * na - 1e-9)
    rest = 1 + F.least(na - F.col("__at_a"), nb - F.col("__at_b"))
    ok = long & (rest >= t / (1 + t) * (na + nb) - 1e-9) & ((F.col("__lo") < F.col("__hi")) & (F.col("__id_a") != F.col("__id_b")) | (F.col("__id_a") < F.col("__id_b")))
    if apart is not None:
        ok = ok & ~F.col("__apart_a").eqNullSafe(F.col("__apart_b"))
    near = left.join(right, [*keys, "__word", "__lo", "__hi"]).where(ok)
    pairs = near.select(*keys, F.least("__id_a", "__id_b").alias("a"), F.greatest("__id_a", "__id_b").alias("b")).distinct()
    both = pairs.join(sets.select(*keys, F.col("__id").alias("a"), F.col("__w").alias("__wa")), [*keys, "a"]).join(sets.select(*keys, F.col("__id").alias("b"), F.col("__w").alias("__wb")), [*keys, "b"])
    shared = F.size(F.array_intersect("__wa", "__wb"))
    return both.withColumn("jaccard", shared / (F.size("__wa") + F.size("__wb") - shared)).where(F.col("jaccard") >= t - 1e-12).select(*keys, "a", "b", "jaccard")
