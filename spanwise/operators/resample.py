"""Resampling by recording: bootstraps and permutation nulls (shift nulls: :mod:`.shifts`).

Draws come from integer arithmetic on replicate and slot numbers, so that they are
the same in any engine. Bootstraps of ratios and of all that is made of sums repeat each
recording's sums, of which there is one row a recording, in the stream of a task;
bootstraps of curves run along one order of the scores with all replicates at once.
Permutation nulls repeat rows in the stream of a task and sum them before any shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import settled
from .metrics import in_ranges
from .ordering import numbered, sums_before


#: The modulus of the numbers that draw and order.
PRIME = 1_000_003


def slot(b: Column, j: Column, n: Column) -> Column:
    """The number below ``n`` that slot ``j`` of replicate ``b`` draws."""
    return (scattered(b, j) * PRIME + scattered(b + 101, j + 7)) % n


def draws(names: DataFrame, key: str, replicates: int) -> DataFrame:
    """``key, drawn`` of the recordings ``names``: the replicates that draw each, as often as they do.

    A replicate draws as many recordings as there are, with replacement. Recordings are
    numbered in order of the key, null first.
    """
    placed = numbered(names.select(key).distinct(), F.col(key).asc_nulls_first())
    n = placed.count()
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))
    slots = names.sparkSession.range(n).select(F.col("id").alias("j"), b.alias("b")).select("b", slot(F.col("b"), F.col("j"), F.lit(n)).alias("place"))
    times = slots.groupBy("place").agg(F.collect_list(F.col("b").cast("int")).alias("drawn"))
    # the draws are as many as replicates times recordings; their size, told from the numbers of places, would have them broadcast
    return placed.join(times.hint("merge"), "place", "left").select(key, F.coalesce("drawn", F.array().cast("array<int>")).alias("drawn"))


def drawn(sums: DataFrame, key: str, replicates: int, times: DataFrame | None = None) -> DataFrame:
    """``b`` and the sums (a row a recording) of the recordings drawn with replacement in replicate b. They are repeated in the stream of a task.

    ``times``: the :func:`draws`, where several metrics share them.
    """
    times = (draws(sums, key, replicates) if times is None else times).withColumnRenamed(key, "__key")
    return sums.join(times, sums[key].eqNullSafe(F.col("__key"))).withColumn("b", F.explode(F.col("drawn").cast("array<bigint>"))).drop("drawn", "__key")


def bootstrap(rows: DataFrame, key: str, sums: dict[str, Column], metrics: dict[str, Column], replicates: int, times: DataFrame | None = None) -> DataFrame:
    """``b`` and any metrics that are columns over sums: ``sums`` are summed by recording and then over each replicate's draw; -1 is all recordings as they are."""
    by = rows.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = [F.sum(n).alias(n) for n in sums]
    every = drawn(by, key, replicates, times).groupBy("b").agg(*totals).unionByName(by.agg(F.lit(-1).cast("long").alias("b"), *totals))
    return every.select("b", *[c.alias(n) for n, c in metrics.items()])


def _weights(cells: list[list[int]], replicates: int) -> np.ndarray:
    """How often each replicate draws the recording of each row; the last column is 1, all recordings as they are."""
    out = np.zeros((len(cells), replicates + 1), np.float64)
    size = np.fromiter(map(len, cells), np.int64, len(cells))
    flat = np.concatenate([np.asarray(c, np.int64) for c in cells]) if len(cells) else np.empty(0, np.int64)
    np.add.at(out, (np.repeat(np.arange(len(cells)), size), flat), 1.0)
    out[:, replicates] = 1.0
    return out


#: Rows whose weights are held at once.
ROWS = 1024


def _range_sums(replicates: int):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at : at + ROWS]
                w = _weights(part["drawn"].tolist(), replicates)
                where = part["__range"].to_numpy()
                for r in np.unique(where).tolist():
                    mine = where == r
                    both = np.stack([part["pos"].to_numpy(float)[mine] @ w[mine], part["neg"].to_numpy(float)[mine] @ w[mine]])
                    held[r] = held.get(r, 0.0) + both
        for r, both in held.items():
            yield pd.DataFrame({"range": r, "b": np.arange(replicates + 1), "pos": both[0], "neg": both[1]})

    return run


def _ordered_sums(replicates: int, above: dict[int, np.ndarray], positives: np.ndarray):
    """Rows in falling order of the score within each range to each replicate's wins and area; ``above``: sums over all higher ranges."""

    def run(batches):
        wins, area = np.zeros(replicates + 1), np.zeros(replicates + 1)
        at, score, tp, fp, own = None, None, None, None, None

        def close():
            # a score's rows count together: ties are one step of the curve and half a win
            p, q = own
            before = np.where(tp + fp > 0, tp / np.maximum(tp + fp, 1), 1.0)
            area[:] += p / np.maximum(positives, 1) * ((tp + p) / np.maximum(tp + p + fp + q, 1) + before) / 2
            wins[:] += q * (tp + p / 2)

        for pdf in batches:
            for k in range(0, len(pdf), ROWS):
                part = pdf.iloc[k : k + ROWS]
                w = _weights(part["drawn"].tolist(), replicates)
                where, value = part["__range"].to_numpy(), part["__score"].to_numpy()
                edge = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (value[1:] != value[:-1])]))
                pos, neg = (np.add.reduceat(part[c].to_numpy(float)[:, None] * w, edge, axis=0) for c in ("pos", "neg"))
                for r, s, p, q in zip(where[edge].tolist(), value[edge].tolist(), pos, neg):
                    if (r, s) != (at, score):
                        if own is not None:
                            close()
                            tp, fp = tp + own[0], fp + own[1]
                        if r != at:
                            tp, fp = above[r]
                        at, score, own = r, s, np.zeros((2, replicates + 1))
                    own[0] += p
                    own[1] += q
        if own is not None:
            close()
            yield pd.DataFrame({"b": np.arange(replicates + 1), "wins": wins, "area": area})

    return run


def bootstrap_curves(rows: DataFrame, key: str, score: str, y: str, replicates: int, times: DataFrame | None = None) -> DataFrame:
    """``b, auroc, pr_auc`` of each replicate's draw of recordings; -1 is all as they are. Null without both classes, or positives.

    Rows are summed by recording and score and carry the replicates that draw their
    recording as one column. Scores are ordered once, in ranges; every replicate's sums
    run along that order together. Of each range and replicate two sums pass the driver.
    """
    counts = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(key, F.col(score).cast("double").alias("__score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))
    # each row carries its recording's draws: in the narrowest numbers that hold a replicate's
    narrow = "tinyint" if replicates <= 1 << 7 else "smallint" if replicates <= 1 << 15 else "int"
    times = (draws(rows, key, replicates) if times is None else times).withColumnRenamed(key, "__key").withColumn("drawn", F.col("drawn").cast(f"array<{narrow}>"))
    placed = in_ranges(counts, "__score", [], pos="pos").select(key, "__score", "__range", "pos", "neg")
    held = settled(placed.join(times, placed[key].eqNullSafe(F.col("__key"))).select("__range", "__score", "pos", "neg", "drawn"))
    told = held.mapInPandas(_range_sums(replicates), "range int, b int, pos double, neg double").groupBy("range", "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()
    ranges = sorted(told["range"].unique().tolist(), reverse=True)
    above, so_far = {}, np.zeros((2, replicates + 1))
    for r in ranges:
        above[r] = so_far
        so_far = so_far + told[told["range"] == r].sort_values("b")[["pos", "neg"]].to_numpy().T
    dealt = held.repartition("__range").sortWithinPartitions("__range", F.desc("__score"))
    sums = dealt.mapInPandas(_ordered_sums(replicates, above, so_far[0]), "b int, wins double, area double").groupBy("b").agg(F.sum("wins").alias("wins"), F.sum("area").alias("area"))
    totals = rows.sparkSession.createDataFrame(pd.DataFrame({"b": np.arange(replicates + 1, dtype=np.int32), "p": so_far[0], "q": so_far[1]}))
    p, q = F.col("p"), F.col("q")
    b = F.when(F.col("b") == replicates, -1).otherwise(F.col("b")).cast("long")
    return totals.join(sums, "b", "left").select(b.alias("b"), (F.col("wins") / F.when(p * q > 0, p * q)).alias("auroc"), F.when(p > 0, F.col("area")).alias("pr_auc"))


def interval(replicates: DataFrame, value: str, n: int) -> DataFrame:
    """The 2.5 and 97.5 % points by sorted index: at int(.025 n) and min(int(.975 n), n - 1)."""
    r = replicates.where(F.col(value).isNotNull()).agg(F.array_sort(F.collect_list(value)).alias("v"))
    size = F.size("v")
    return r.select(F.try_element_at("v", (F.floor(size * 0.025) + 1).cast("int")).alias("low"), F.try_element_at("v", (F.least(F.floor(size * 0.975), size - 1) + 1).cast("int")).alias("high"))


def bootstrap_ratio(rows: DataFrame, key: str, k: Column, n: Column, replicates: int) -> DataFrame:
    """Per replicate the ratio of summed ``k`` to summed ``n``."""
    sums = rows.groupBy(key).agg(F.sum(k).alias("num"), F.sum(n).alias("den"))
    return drawn(sums, key, replicates).groupBy("b").agg((F.sum("num") / F.when(F.sum("den") > 0, F.sum("den"))).alias("ratio"))


def bootstrap_auroc(rows: DataFrame, key: str, scores: list[str], y: str, replicates: int) -> DataFrame:
    """Per replicate (b >= 0) the AUROC of each score on the same draw of recordings."""
    out, times = None, settled(draws(rows, key, replicates))
    for s in scores:
        a = bootstrap_curves(rows, key, s, y, replicates, times).where("b >= 0").select("b", F.col("auroc").alias(f"auroc_{s}"))
        out = a if out is None else out.join(a, "b")
    return out


def p_value(null: DataFrame, value: str) -> DataFrame:
    """(1 + replicates at least as large) / (1 + replicates), replicate -1 being the observed one."""
    observed = null.where("b = -1").select(F.col(value).alias("observed"))
    return null.where("b >= 0").join(F.broadcast(observed)).groupBy("observed").agg(F.avg(value).alias("null_mean"), ((1 + F.count_if(F.col(value) >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"))


def derangement(rows: DataFrame, key: str, row: str) -> DataFrame:
    """Each row with a partner of another recording: the recording-sorted list turned by the largest group's size.

    Raises where one recording holds more than half of the rows.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if sizes["n"] is None or 2 * sizes["most"] > sizes["n"]:
        raise ValueError("no derangement: a recording holds more than half of the rows")
    # numbers in order of the key without one task for all rows: counts before each key, then ranks within
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    before = sums_before(counts, key, "n").select(key, "before")
    numbered = rows.select(key, row).join(before, key).withColumn("k", F.col("before") + F.row_number().over(W.partitionBy(key).orderBy(row)) - 1)
    other = numbered.select(F.pmod(F.col("k") - F.lit(sizes["most"]), F.lit(sizes["n"])).alias("k"), F.col(key).alias(f"{key}_partner"), F.col(row).alias(f"{row}_partner"))
    return numbered.select(key, row, "k").join(other, "k").drop("k")


#: Parts that a replicate's order is dealt into; only the part with the cut is ordered row by row.
PARTS = 1024


def scattered(b: Column, row: Column) -> Column:
    """A number below ``PRIME`` for a row in a replicate, the same in any engine."""
    r = F.pmod(row.cast("long"), F.lit(PRIME))
    q = F.pmod(row.cast("long"), F.lit(10_007))
    return (r * ((b * 7919 + 104_729) % PRIME) + q * q * (b + 17)) % PRIME


def shuffled(b: str, row: str) -> Column:
    """:func:`scattered` of two columns by name."""
    return scattered(F.col(b), F.col(row))


def first_rows(rows: DataFrame, row: str, replicates: int, n: Column) -> DataFrame:
    """``rows`` for each replicate ``b``, with ``first``: whether a row is among the ``n`` first in the replicate's order.

    ``n`` is an aggregate over all rows. Where a replicate's order is cut is found among
    sums of its parts; a window then orders the rows of one part. Rows are repeated in
    the stream of a task, not shuffled.
    """
    each = rows.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))).withColumn("__h", shuffled("b", row)).withColumn("__part", F.floor(F.col("__h") * PARTS / PRIME))
    wanted = rows.agg(n.cast("long").alias("__n"))  # one row
    sums = each.groupBy("b", "__part").agg(F.count(F.lit(1)).alias("__c"))  # PARTS rows a replicate
    before = sums.withColumn("__before", F.sum("__c").over(W.partitionBy("b").orderBy("__part")) - F.col("__c")).join(F.broadcast(wanted))
    cut = before.where((F.col("__before") < F.col("__n")) & (F.col("__before") + F.col("__c") >= F.col("__n"))).select("b", F.col("__part").alias("__cut"), (F.col("__n") - F.col("__before")).alias("__left"))
    told = each.join(F.broadcast(cut), "b", "left")  # a row a replicate
    here = F.coalesce(F.col("__part") == F.col("__cut"), F.lit(False))
    edge = told.where(here).withColumn("first", F.row_number().over(W.partitionBy("b").orderBy("__h", row)) <= F.col("__left"))
    rest = told.where(~here).withColumn("first", F.coalesce(F.col("__part") < F.col("__cut"), F.lit(False)))
    return edge.unionByName(rest).drop("__h", "__part", "__cut", "__left")


def permuted(rows: DataFrame, row: str, y: str, replicates: int) -> DataFrame:
    """Labels dealt anew in each replicate: the same number of ones, to the first rows of its order."""
    return first_rows(rows, row, replicates, F.coalesce(F.sum(y), F.lit(0))).withColumn("y_permuted", F.col("first").cast("int")).drop("first")
