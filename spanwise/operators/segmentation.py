"""Scores of predicted segments against true ones, by recording."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sc
from . import intervals, matching, scorers

#: IoU that a pair must exceed to be matched, and the levels of the F1s.
MATCHED, LEVELS = 0.1, (0.3, 0.5, 0.7)


def candidates(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping pairs of ``pred`` (p, s, e) and ``truth`` (g, gs, ge) with their ``iou``, rounded to nine places.

    Spans are dealt to buckets of the mean length of the true ones of all recordings, an
    equi-join; a pair is taken in the first bucket that both are in.
    """
    width = truth.agg(F.greatest(F.avg(F.col("ge") - F.col("gs")), F.lit(1e-6)).alias("__w"))

    def dealt(rows, s, e, name):
        lo, hi = F.floor(F.col(s) / F.col("__w")).cast("long"), F.floor(F.col(e) / F.col("__w")).cast("long")
        return rows.where(F.col(e) >= F.col(s)).join(F.broadcast(width)).withColumn(name, lo).withColumn("__at", F.explode(F.sequence(lo, hi))).drop("__w")  # one row

    both = dealt(pred, "s", "e", "__p0").join(dealt(truth, "gs", "ge", "__g0"), [*keys, "__at"])
    first = both.where(F.col("__at") == F.greatest("__p0", "__g0")).drop("__p0", "__g0", "__at")
    return first.where((F.col("gs") <= F.col("e")) & (F.col("ge") >= F.col("s"))).withColumn("iou", F.round(sc.iou_hull(F.col("s"), F.col("e"), F.col("gs"), F.col("ge")), 9))


def matched(pred: DataFrame, truth: DataFrame, keys: list[str], over: float = MATCHED) -> DataFrame:
    """Greedy one-to-one pairs by falling IoU: keys, ``p, g, iou``."""
    return matching.greedy_pairs(candidates(pred, truth, keys).where(F.col("iou") > over), keys, "iou", "p", "g", (F.least("s", "gs"), F.greatest("e", "ge")))


def counts(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """``n_pred, n_gt`` of each recording that has either."""
    return pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred")).join(truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt")), keys, "full").na.fill(0, ["n_pred", "n_gt"])


def compound(duration: Column) -> Column:
    """IoU times how near the starts and the ends are, in shares of the recording's length."""
    start, end = 1 - F.abs(F.col("gs") - F.col("s")) / duration, 1 - F.abs(F.col("ge") - F.col("e")) / duration
    return F.col("iou") * F.when(duration > 0, F.greatest(start * end, F.lit(0.0))).otherwise(1.0)


def metrics(pred: DataFrame, truth: DataFrame, keys: list[str], durations: DataFrame) -> DataFrame:
    """Per recording: F1 at each level of IoU, mean IoU of matched pairs, boundary score, coverage, overlap, count accuracy and rewards.

    ``boundary`` divides the compound scores by the number of true segments,
    ``iou_reward`` by the larger number, so that more segments do not pay.
    ``durations``: keys and ``duration``. Recordings without predictions or truths score 0.
    """
    pairs = matched(pred, truth, keys).join(pred, [*keys, "p"]).join(truth, [*keys, "g"]).join(durations, keys, "left")
    scored = pairs.groupBy(*keys).agg(*[F.count_if(F.col("iou") >= x).alias(f"tp_{int(x * 100)}") for x in LEVELS], F.avg("iou").alias("mean_iou"), F.sum(compound(F.col("duration"))).alias("compound"))
    window = truth.groupBy(*keys).agg(F.min("gs").alias("t0"), F.max("ge").alias("t1"))
    inside = pred.join(window, keys).withColumns({"s": F.greatest("s", "t0"), "e": F.least("e", "t1")}).where("e > s")
    covered = intervals.covered(inside, keys, "s", "e").select(*keys, "covered")
    w = matching.window_by(keys, "s", "e")
    shared = pred.withColumn("over", F.greatest(F.col("e") - F.lead("s").over(w), F.lit(0.0))).groupBy(*keys).agg(F.sum("over").alias("over"), F.sum(F.col("e") - F.col("s")).alias("total"))
    all_ = counts(pred, truth, keys).join(scored, keys, "left").join(window, keys, "left").join(covered, keys, "left").join(shared, keys, "left")
    n_pred, n_gt = F.col("n_pred"), F.col("n_gt")
    some = (n_pred > 0) & (n_gt > 0)
    coverage = F.least(F.coalesce("covered", F.lit(0.0)) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-6)), F.lit(1.0))
    overlap = F.least(F.coalesce("over", F.lit(0.0)) / F.when(F.col("total") != 0, F.col("total")).otherwise(1e-6), F.lit(1.0))
    out = {f"f1_{int(x * 100)}": sc.safe_ratio(2 * F.coalesce(f"tp_{int(x * 100)}", F.lit(0)), n_pred + n_gt) for x in LEVELS}
    total = F.coalesce("compound", F.lit(0.0))
    out |= {"mean_iou": F.coalesce("mean_iou", F.lit(0.0)), "boundary": sc.safe_ratio(total, n_gt), "coverage": coverage, "overlap": overlap, "count_acc": F.greatest(1 - F.abs(n_pred - n_gt) / n_gt, F.lit(0.0)), "iou_reward": sc.safe_ratio(total, F.greatest(n_pred, n_gt))}
    out = {k: F.when(some, v).otherwise(0.0) for k, v in out.items()}
    table = all_.select(*keys, "n_pred", "n_gt", *[v.alias(k) for k, v in out.items()])
    return table.withColumn("seq_reward", F.when((F.col("n_pred") > 0) & (F.col("n_gt") > 0), 0.4 * F.col("coverage") + 0.3 * (1 - F.col("overlap")) + 0.3 * F.col("count_acc")).otherwise(0.0))


def name_reward(pred: DataFrame, truth: DataFrame, keys: list[str], similarity: Callable[[Column, Column], Column], generic: float = 0.5) -> DataFrame:
    """Per recording the mean over true segments of how like its own name a matched one's is, less what it is like another's.

    ``pred`` and ``truth`` have a ``label``; ``similarity`` builds the column for two labels.
    """
    return _named(_labelled(pred, truth, keys).withColumn("sim", similarity(F.col("said"), F.col("name"))), pred, truth, keys, generic)


def name_reward_by(pred: DataFrame, truth: DataFrame, keys: list[str], scorer: str | Callable[[], scorers.Scorer], generic: float = 0.5) -> DataFrame:
    """:func:`name_reward` with a scorer that runs in Python (see :mod:`.scorers`); a pair that it fails on counts as unlike."""
    each = scorers.score_pairs(_labelled(pred, truth, keys), "said", "name", scorer)
    return _named(each.withColumn("sim", F.coalesce("score", F.lit(0.0))), pred, truth, keys, generic)


def _labelled(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Each matched prediction's label beside every true label of its recording."""
    pairs = matched(pred, truth, keys).join(pred.select(*keys, "p", F.col("label").alias("said")), [*keys, "p"])
    return pairs.join(truth.select(*keys, F.col("g").alias("other"), F.col("label").alias("name")), keys)


def _named(each: DataFrame, pred: DataFrame, truth: DataFrame, keys: list[str], generic: float) -> DataFrame:
    own = F.col("other") == F.col("g")
    best = each.groupBy(*keys, "g").agg(F.max(F.when(own, F.col("sim"))).alias("own"), F.max(F.when(~own, F.col("sim"))).alias("else"))
    gained = best.groupBy(*keys).agg(F.sum(F.greatest(F.col("own") - generic * F.coalesce("else", F.lit(0.0)), F.lit(0.0))).alias("gained"))
    return counts(pred, truth, keys).join(gained, keys, "left").select(*keys, F.when((F.col("n_pred") > 0) & (F.col("n_gt") > 0), F.coalesce("gained", F.lit(0.0)) / F.col("n_gt")).otherwise(0.0).alias("name_reward"))
