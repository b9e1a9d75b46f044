"""Mixing sources to target weights by temperature, realised as block permutations.

A source's share of all tokens raised to an exponent, and normalised, is its
weight; 1 keeps the shares, 0 makes all sources equal. The exponent is bisected to
the largest entropy or the smallest exponent that a limit allows: a target entropy,
or the most often that any source may be repeated. The budget is the number of
tokens to emit; without one it is the largest that lets the source that needs it
least often pass once, so that no document is lost.

A source's tokens are emitted in blocks. Each block is a whole permutation of the
source's documents, by a hash of the document and the block's number. The last
block of a source is cut where its tokens are reached: the document that holds the
last of them is the last. Hashes are dealt into buckets to find that place, so that
no task sees a whole source.

Defined cases: a null source is a source of its own; null text has no tokens, and a
document without tokens stands in every whole block; a source without any token has
weight 0 and each of its documents is emitted once, as it costs no budget; rows that
repeat are separate documents, and those equal in ``doc_id`` and text stand together
in a block; a budget under which a source is not passed once leaves documents out; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, scratch

#: Parts that a source's hashes are dealt into; only the part with the cut is ordered row by row.
BUCKETS = 4096
#: Exponents tried in one pass over the sources, and passes: the bisection's steps.
TRIED, PASSES = 16, 6
SEED = 17


def words(text: Column) -> Column:
    """Words separated by white space, the tokens that shares count."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


@dataclass
class Mix:
    exponent: float
    entropy: float
    budget: float
    sources: DataFrame  # source, tokens, weight, repeats


def fit(shares: DataFrame, entropy: float | None = None, most_repeats: float | None = None, budget: float | None = None) -> Mix:
    """The exponent for ``shares`` (source, tokens).

    ``entropy``: in (0, 1], as a share of the largest possible, log n. With
    ``most_repeats`` the exponent is the least at which no source with tokens is
    passed more often than that, where the source with the lowest rate passes once
    (or the budget is given). Both: the larger exponent. Neither: 1. Sums over the
    sources are the only thing that leaves Spark, so their number does not matter.
    """
    some = shares.where("tokens > 0")
    head = some.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not head["n"]:
        return Mix(1.0, 0.0, 0.0, shares.withColumn("weight", F.lit(0.0)).withColumn("repeats", F.lit(0.0)))
    total, n, top, low = float(head["t"]), head["n"], head["most"] / head["t"], head["least"] / head["t"]
    p = F.col("tokens") / F.lit(total)

    def sums(exponents: list[float]) -> tuple[np.ndarray, np.ndarray]:
        row = some.agg(*[F.sum(F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(exponents)], *[F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"s{i}") for i, a in enumerate(exponents)]).first()
        k = len(exponents)
        return np.array(row[:k], np.float64), np.array(row[k:], np.float64)

    def entropies(exponents: list[float]) -> np.ndarray:
        z, s = sums(exponents)
        return np.log(z) - np.array(exponents) * s / z

    def repeats(exponents: list[float]) -> np.ndarray:
        # weight over share falls with the share for exponents under 1: the smallest source is repeated most
        a = np.array(exponents)
        if budget is None:
            return (low / top) ** (a - 1)
        return low**a / sums(exponents)[0] * budget / (low * total)

    def least_exponent(holds) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            tried = np.linspace(lo, hi, TRIED + 1).tolist()
            ok = holds(tried)
            k = int(np.argmax(ok)) if ok.any() else TRIED
            lo, hi = tried[max(k - 1, 0)], tried[k]
        return hi

    exponent = 1.0
    found = []
    if entropy is not None:
        # entropy falls as the exponent grows: the largest exponent that still reaches the target
        target = entropy * np.log(n)
        found.append(1.0 if entropies([1.0])[0] >= target else 1.0 - least_exponent(lambda t: entropies([1.0 - x for x in t]) >= target - 1e-9))
    if most_repeats is not None:
        found.append(least_exponent(lambda t: repeats(t) <= most_repeats + 1e-9))
    if found:
        exponent = max(found)
    z, s = sums([exponent])
    at_entropy = float(np.log(z[0]) - exponent * s[0] / z[0])
    if budget is None:
        budget = float(total * top / (top**exponent / z[0]))
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(exponent)) / F.lit(float(z[0]))).otherwise(0.0)
    sources = shares.withColumn("weight", weight).withColumn("repeats", F.when(F.col("tokens") > 0, F.col("weight") * F.lit(budget) / F.col("tokens")).otherwise(0.0))
    return Mix(exponent, at_entropy, budget, sources)


def _keyed() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _place(key: Column, block: Column) -> Column:
    """A document's place in a block of its source, in 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(key, block.cast("long"), F.lit(SEED)), 1)


def sources_of(rows: DataFrame, entropy: float | None, most_repeats: float | None, budget: float | None) -> tuple[DataFrame, Mix]:
    """A row a source: ``of, weight, whole`` (blocks) and ``last``, the place of the last document of the partial block (-1: none); and the mix.

    ``rows`` has ``source, tokens, row_key``. The last place is found among the sums
    of a source's buckets first, then among the places within that one bucket.
    """
    mix = fit(cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources"), entropy, most_repeats, budget)
    whole = F.floor(F.col("repeats") + 1e-6)
    part = F.greatest(F.col("repeats") - whole, F.lit(0.0))
    sources = cut(mix.sources.select(F.col("source").alias("of"), "weight", F.when(F.col("tokens") > 0, whole).otherwise(1).cast("long").alias("whole"), F.when(part > 1e-6, part * F.col("tokens")).otherwise(0.0).alias("rest")), "mix-plan")
    placed = rows.join(sources.where("rest > 0"), rows["source"].eqNullSafe(sources["of"])).withColumn("h", _place(F.col("row_key"), F.col("whole"))).withColumn("bucket", F.shiftrightunsigned("h", 51).cast("int"))  # the upper 12 of 63 bits
    sums = placed.groupBy("of", "bucket").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    before = sums.withColumn("before", F.sum("t").over(W.partitionBy("of").orderBy("bucket")) - F.col("t"))
    edge = cut(before.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest"))).groupBy("of").agg(F.min(F.struct("bucket", "before")).alias("c")).select(F.col("of").alias("cut_of"), F.col("c.bucket").alias("cut_bucket"), F.col("c.before").alias("cut_before")), "mix-cuts")
    inside = placed.join(edge, placed["of"].eqNullSafe(edge["cut_of"]) & (F.col("bucket") == F.col("cut_bucket"))).groupBy("of", "h").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"), F.first("cut_before").alias("cut_before"))
    so_far = inside.withColumn("so_far", F.col("cut_before") + F.sum("t").over(W.partitionBy("of").orderBy("h")) - F.col("t"))
    last = so_far.where(F.col("so_far") < F.col("rest")).groupBy("of").agg(F.max("h").alias("last")).select(F.col("of").alias("last_of"), "last")
    return cut(sources.join(last, sources["of"].eqNullSafe(last["last_of"]), "left").select("of", "weight", "whole", F.coalesce("last", F.lit(-1).cast("long")).alias("last")), "mix-last", keep=True), mix


def _blocks(key: Column) -> Column:
    """In how many blocks of its source a document is emitted, beside the columns of :func:`sources_of`."""
    return F.col("whole") + (_place(key, F.col("whole")) <= F.col("last")).cast("long")


def plan(docs: DataFrame, entropy: float | None = None, most_repeats: float | None = None, budget: float | None = None) -> tuple[DataFrame, Mix]:
    """Per document row (``row_key, doc_id, source, tokens, weight``) in how many blocks it is emitted: ``blocks``; and the mix.

    A source whose repeats come to a whole number within a millionth has no last,
    partial block.
    """
    rows = cut(docs.select("doc_id", "source", words(F.col("text").cast("string")).alias("tokens"), _keyed().alias("row_key")), "mix-rows")
    sources, mix = sources_of(rows, entropy, most_repeats, budget)
    return rows.join(sources, rows["source"].eqNullSafe(sources["of"])).select("row_key", "doc_id", "source", "tokens", "weight", _blocks(F.col("row_key")).alias("blocks")), mix


def schedule(docs: DataFrame, **limits) -> DataFrame:
    """One row for each time that a document is emitted: ``doc_id, source, tokens, weight, block, place``.

    Blocks count from 0; ``place`` is the document's hash in the block, by which a
    reader orders a source's block.
    """
    planned, _ = plan(docs, **limits)
    each = planned.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return each.select("doc_id", "source", "tokens", "weight", "block", F.shiftrightunsigned(F.xxhash64("row_key", "block", F.lit(SEED)), 1).alias("place"))


def mixed(docs: DataFrame, entropy: float | None = None, most_repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as it is emitted, all columns kept.

    A row's blocks follow from its source's row and its own hash: the texts are not shuffled.
    """
    with scratch(docs.sparkSession):
        rows = cut(docs.select("source", words(F.col("text").cast("string")).alias("tokens"), _keyed().alias("row_key")), "mix-rows")
        sources, _ = sources_of(rows, entropy, most_repeats, budget)
    names = [f"__{k}" for k in range(len(docs.columns))]
    keyed = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)], F.col("source").alias("__source"), _keyed().alias("__key"))
    told = keyed.join(sources, keyed["__source"].eqNullSafe(sources["of"])).withColumn("__blocks", _blocks(F.col("__key")))
    # a sequence from 1 to 0 would count down
    told = told.where("__blocks > 0").withColumn("__block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__blocks"))))
    return told.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
