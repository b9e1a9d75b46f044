"""Evaluation of candidate sets: items with scored candidates, some of which are true.

An item has one row a candidate. All metrics but the pooled curves are ratios of sums
over items, so that they can be told of any weighting of items, as in bootstraps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics
from ..functions.scalar import safe_ratio

#: Ranks within which a true candidate counts as recalled.
RECALL_AT = (1, 2, 3)


def by_item(candidates: DataFrame, keys: list[str], score: str, true: str, label: str, tau: Column) -> DataFrame:
    """Sums of each item (``keys``) for candidates over the threshold ``tau``; ranks by falling score, then label.

    An item without true candidates is atomic, one with some compound. A null score is below every threshold and ranks last.
    """
    w = W.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), label)
    told = candidates.withColumn("__rank", F.row_number().over(w)).withColumn("__in", F.coalesce(F.col(score) > tau, F.lit(False)))
    is_true, is_in = F.col(true) == 1, F.col("__in")
    sums = told.groupBy(*keys).agg(F.count_if(is_true & is_in).alias("tp"), F.count_if(~is_true & is_in).alias("fp"), F.count_if(is_true & ~is_in).alias("fn"), F.min(F.when(is_true, F.col("__rank"))).alias("__best"))
    compound = (F.col("tp") + F.col("fn") > 0).cast("long")
    exact = ((F.col("fp") == 0) & (F.col("fn") == 0)).cast("long")
    more = {
        "items": F.lit(1).cast("long"), "compound": compound, "atomic": 1 - compound, "exact": exact, "compound_exact": exact * compound,
        "empty": (1 - compound) * (F.col("fp") == 0).cast("long"), "atomic_fp": (1 - compound) * F.col("fp"), "card": F.abs(F.col("fp") - F.col("fn")),
    }
    for k in RECALL_AT:
        more[f"recalled_{k}"] = F.coalesce(F.col("__best") <= k, F.lit(False)).cast("long")
    return sums.withColumns(more).drop("__best")


#: What :func:`by_item` sums.
SUMS = ("tp", "fp", "fn", "items", "compound", "atomic", "exact", "compound_exact", "empty", "atomic_fp", "card", *(f"recalled_{k}" for k in RECALL_AT))


def suite(of=F.col) -> dict[str, Column]:
    """The metrics as columns over sums; ``of`` gives the column of a sum by its name. Null where nothing can be said."""

    def share(a: str, b: str) -> Column:
        return of(a) / F.when(of(b) > 0, of(b))

    p, r = safe_ratio(of("tp"), of("tp") + of("fp")), safe_ratio(of("tp"), of("tp") + of("fn"))
    return {
        "precision": p, "recall": r, "f1": safe_ratio(2 * of("tp"), 2 * of("tp") + of("fp") + of("fn")),
        "empty_accuracy": share("empty", "atomic"), "fp_per_atomic": share("atomic_fp", "atomic"), "exact": share("exact", "items"), "compound_exact": share("compound_exact", "compound"),
        "cardinality_mae": share("card", "items"), **{f"recall_at_{k}": share(f"recalled_{k}", "compound") for k in RECALL_AT},
    }


def fold_thresholds(candidates: DataFrame, fold: str, score: str, true: str, folds: int) -> DataFrame:
    """``fold, tau``: of each fold the threshold with the best F1 on the candidates of all others."""
    each = candidates.withColumn("__own", F.col(fold)).drop(fold).withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col(fold) != F.col("__own"))
    return metrics.best_f1(each, [fold], score, true).select(fold, "tau")


def report(candidates: DataFrame, keys: list[str], fold: str, score: str, true: str, label: str, folds: int) -> DataFrame:
    """One row with the whole suite for candidates decided by the thresholds of the other folds: AUROC and PR-AUC of the pooled scores, and :func:`suite`."""
    tau = fold_thresholds(candidates, fold, score, true, folds)  # a row a fold
    items = by_item(candidates.join(F.broadcast(tau), fold, "left"), keys, score, true, label, F.col("tau"))
    sums = items.agg(*[F.sum(c).alias(c) for c in SUMS]).select("items", *[c.alias(n) for n, c in suite().items()])
    pooled = metrics.auroc(candidates, [], score, true).select("auroc").join(metrics.pr_auc(candidates, [], score, true))
    return pooled.join(sums)  # a row each
