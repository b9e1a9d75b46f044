"""Evaluation statistics as window and aggregate expressions; no row is compared with every other, and no task orders a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio, wilson


def by_value(rows: DataFrame, keys: list[str], score: str, **sums: Column) -> DataFrame:
    """Rows summed by group and score, so that later windows order distinct scores only."""
    return rows.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys, score).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def auroc(rows: DataFrame, keys: list[str], score: str, y: str) -> DataFrame:
    """Area under the ROC curve by group, a tie counting one half; null without both classes."""
    return weighted_auroc(rows, keys, score, y, None)


def weighted_auroc(rows: DataFrame, keys: list[str], score: str, y: str, n: str | None) -> DataFrame:
    """:func:`auroc` of rows that stand for ``n`` each (None: one)."""
    one = F.lit(1).cast("long") if n is None else F.col(n)
    counts = by_value(rows, keys, score, pos=F.when(F.col(y) == 1, one).otherwise(0), neg=F.when(F.col(y) == 0, one).otherwise(0))
    below = F.sum("neg").over(W.partitionBy(*keys, "__range").orderBy(score)) + F.col("neg_below") - F.col("neg")
    wins = in_ranges(counts, score, keys, neg="neg").withColumn("__w", F.col("pos") * (below + F.col("neg") / 2))
    return wins.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), (F.sum("__w") / F.when(F.sum("pos") * F.sum("neg") > 0, F.sum("pos") * F.sum("neg"))).alias("auroc"))


#: Ranges that values are dealt into.
RANGES = 64


def in_ranges(rows: DataFrame, x: str, keys: list[str], **sums: str) -> DataFrame:
    """``rows`` with ``__range``, one of about ``RANGES`` ranges of ``x`` with like numbers of all rows, and of each of ``sums`` the sum over the group's lower (``*_below``), higher (``*_above``) and all (``*_total``) ranges.

    A window over ``keys`` and ``__range`` then orders what a group has in a range: a
    share of ``1 / RANGES`` of all rows at most, beside ties, so that no task orders a large group. The
    bounds are one row, a group's sums by range another. Groups may be null.
    """
    bounds = rows.agg(F.percentile_approx(F.col(x).cast("double"), [k / RANGES for k in range(1, RANGES)], 1000).alias("__bounds"))  # one row
    placed = rows.join(F.broadcast(bounds)).withColumn("__range", F.size(F.filter(F.coalesce("__bounds", F.array().cast("array<double>")), lambda b: b < F.col(x)))).drop("__bounds")
    ranges = placed.groupBy(*keys, "__range").agg(*[F.sum(c).alias(c) for c in sums.values()])
    totals = ranges.groupBy(*keys).agg(F.collect_list(F.struct("__range", *sums.values())).alias("__totals"))
    out = _beside(placed, totals, keys)

    def over(c: str, side: str) -> Column:
        mine = {"below": lambda t: t["__range"] < F.col("__range"), "above": lambda t: t["__range"] > F.col("__range"), "total": lambda t: F.lit(True)}[side]
        return F.aggregate(F.filter("__totals", mine), F.lit(0).cast("long"), lambda acc, t: acc + t[c].cast("long"))

    return out.withColumns({f"{name}_{side}": over(c, side) for name, c in sums.items() for side in ("below", "above", "total")}).drop("__totals")


def _beside(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their group's row in ``one``."""
    if not keys:
        return rows.join(F.broadcast(one))  # one row
    names = {k: f"__of_{i}" for i, k in enumerate(keys)}
    same = None
    for k, n in names.items():
        each = rows[k].eqNullSafe(F.col(n))
        same = each if same is None else same & each
    return rows.join(one.withColumnsRenamed(names), same).drop(*names.values())


def _curve(rows: DataFrame, keys: list[str], score: str, y: str, descending: bool = True) -> DataFrame:
    """Per distinct score its own sums ``pos, all``, those at it or beyond, ``tp, n``, and the group's positives ``all_tp``."""
    counts = by_value(rows, keys, score, pos=(F.col(y) == 1).cast("long"), all=F.lit(1).cast("long"))
    w = W.partitionBy(*keys, "__range").orderBy(F.col(score).desc() if descending else F.col(score))
    side = "above" if descending else "below"
    upto = {"tp": F.sum("pos").over(w) + F.col(f"pos_{side}"), "n": F.sum("all").over(w) + F.col(f"all_{side}")}
    return in_ranges(counts, score, keys, pos="pos", all="all").select(*keys, score, "pos", "all", *[c.alias(k) for k, c in upto.items()], F.col("pos_total").alias("all_tp"))


def cumulative(rows: DataFrame, keys: list[str], score: str, y: str, descending: bool = True) -> DataFrame:
    """Per distinct score how many rows, and of them positives, are at it or beyond: ``n, tp, fp``."""
    return _curve(rows, keys, score, y, descending).drop("pos", "all", "all_tp").withColumn("fp", F.col("n") - F.col("tp"))


def _with_before(rows: DataFrame, keys: list[str], score: str, y: str) -> DataFrame:
    """The curve with the sums before each score (``tp_before, n_before``) and all positives (``all_tp``)."""
    return _curve(rows, keys, score, y).withColumns({"tp_before": F.col("tp") - F.col("pos"), "n_before": F.col("n") - F.col("all")})


def kth_largest(rows: DataFrame, x: str, k: Column) -> DataFrame:
    """``k, threshold``: the ``k``-th largest value of ``x`` over all rows, where ``k`` is an aggregate over them; null beyond their number."""
    wanted = rows.agg(k.alias("k"))  # one row
    counts = by_value(rows, [], x, n=F.lit(1).cast("long"))
    upto = in_ranges(counts, x, [], n="n").withColumn("__upto", F.sum("n").over(W.partitionBy("__range").orderBy(F.col(x).desc())) + F.col("n_above"))
    return upto.join(F.broadcast(wanted)).groupBy("k").agg(F.max(F.when(F.col("__upto") >= F.col("k"), F.col(x))).alias("threshold"))


def pr_auc(rows: DataFrame, keys: list[str], score: str, y: str) -> DataFrame:
    """Area under precision over recall by trapezoids from (0, 1), a step for each distinct score."""
    precision = F.col("tp") / F.col("n")
    before = F.when(F.col("n_before") > 0, F.col("tp_before") / F.col("n_before")).otherwise(1.0)
    area = F.col("pos") / F.when(F.col("all_tp") > 0, F.col("all_tp")) * (precision + before) / 2
    return _with_before(rows, keys, score, y).withColumn("__a", area).groupBy(*keys).agg(F.sum("__a").alias("pr_auc"))


def prf(pos_gold: Column, pos_pred: Column) -> list[Column]:
    """Counts and precision, recall, F1 and accuracy of predicates, as aggregate columns."""
    tp, fp = F.count_if(pos_gold & pos_pred), F.count_if(~pos_gold & pos_pred)
    fn, tn = F.count_if(pos_gold & ~pos_pred), F.count_if(~pos_gold & ~pos_pred)
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"), safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy")]


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa over rows that both annotators decided; null where chance agreement is 1."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    left = both.groupBy(a).agg(F.sum("n").alias("na")).withColumnRenamed(a, "v")
    right = both.groupBy(b).agg(F.sum("n").alias("nb")).withColumnRenamed(b, "v")
    total = both.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    chance = left.join(right, "v").agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return total.join(chance).select("n", po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def average_ranks(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """``rank`` of each distinct value of ``x`` in its group, from 1, ties sharing the mean of theirs; ``n``: how many rows have it."""
    counts = by_value(rows, keys, x, n=F.lit(1).cast("long"))
    upto = F.sum("n").over(W.partitionBy(*keys, "__range").orderBy(x)) + F.col("n_below")
    return in_ranges(counts, x, keys, n="n").select(*keys, x, "n", (upto - (F.col("n") - 1) / 2).alias("rank"))


def spearman(rows: DataFrame, keys: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    """Correlation of average ranks by group; null for few rows or no variance.

    Rows are summed by their pair of values first. The mean of average ranks is (n + 1) / 2.
    """
    held = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    pairs = held.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("__c"))
    for x in (a, b):
        ranks = average_ranks(held, keys, x).drop("n").withColumnRenamed("rank", f"__r_{x}")
        pairs = _beside(pairs, ranks, [*keys, x])
    sizes = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    c, da, db = F.col("__c"), F.col(f"__r_{a}") - (F.col("__n") + 1) / 2, F.col(f"__r_{b}") - (F.col("__n") + 1) / 2
    sums = _beside(pairs, sizes, keys).groupBy(*keys).agg(F.sum("__c").alias("n"), F.sum(c * da * db).alias("__ab"), F.sum(c * da * da).alias("__aa"), F.sum(c * db * db).alias("__bb"))
    ok = (F.col("n") >= least) & (F.col("__aa") > 0) & (F.col("__bb") > 0)
    return sums.select(*keys, "n", F.when(ok, F.col("__ab") / F.sqrt(F.col("__aa") * F.col("__bb"))).alias("rho"))


def entropies(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Entropy of a, of a given b, and their mutual information, in bits."""
    joint = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))

    def bits(counts: DataFrame, name: str) -> DataFrame:
        # H = log2 N - sum(n log2 n) / N, from one aggregate
        return counts.agg((F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")).alias(name))

    ha = bits(joint.groupBy(a).agg(F.sum("n").alias("n")), "h_a")
    hb = bits(joint.groupBy(b).agg(F.sum("n").alias("n")), "h_b")
    hab = bits(joint, "h_ab")
    return ha.join(hb).join(hab).select("h_a", (F.col("h_ab") - F.col("h_b")).alias("h_a_given_b"), (F.col("h_a") + F.col("h_b") - F.col("h_ab")).alias("mutual_information"))


def risk_coverage(rows: DataFrame, thresholds: list[float], score: str, good: str) -> DataFrame:
    """Per threshold: kept, coverage over all rows, those without a score included, precision and its interval."""
    grid = rows.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    # one row a distinct score is compared with the thresholds, which are few
    counts = rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("k"))
    kept = F.col(score) >= F.col("threshold")
    out = counts.join(F.broadcast(grid)).groupBy("threshold").agg(F.sum("n").alias("total"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(kept, F.col("k")).otherwise(0)).alias("right"))
    lo, hi = wilson(F.col("right"), F.col("kept"))
    return out.select("threshold", "kept", (F.col("kept") / F.col("total")).alias("coverage"), F.when(F.col("kept") > 0, F.col("right") / F.col("kept")).alias("precision"), lo.alias("wilson_low"), hi.alias("wilson_high"))


def threshold_for(rows: DataFrame, score: str, y: str, target: float, least: int, buffer: int = 0, descending: bool = True) -> DataFrame:
    """The loosest score whose prefix of at least ``least`` rows still has precision ``target`` with ``buffer`` more errors."""
    curve = cumulative(rows, [], score, y, descending)
    ok = (F.col("n") >= least) & (F.col("tp") / (F.col("n") + buffer) >= target)
    return curve.where(ok).agg(F.max_by(score, "n").alias("threshold"), F.max("n").alias("selected"), F.max_by("tp", "n").alias("right"))


def best_f1(rows: DataFrame, keys: list[str], score: str, y: str) -> DataFrame:
    """The best F1 over cuts "score > observed score", the lowest such cut of ties."""
    above = _with_before(rows, keys, score, y)
    f1 = safe_ratio(2 * F.col("tp_before"), F.col("n_before") + F.col("all_tp"))
    return above.withColumn("f1", f1).groupBy(*keys).agg(F.max("f1").alias("best_f1"), F.max_by(F.col(score), F.struct(F.round("f1", 9), -F.col(score))).alias("tau"))


def upper_median(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Per group the element at half the count (``n, upper_median``), of values in order, not interpolated: from counts of distinct values."""
    counts = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(*keys, "__range").orderBy(x)) + F.col("n_below")
    at = in_ranges(counts, x, keys, n="n").withColumns({"upto": upto, "all": F.col("n_total")})
    return at.where((F.col("upto") > F.floor(F.col("all") / 2))).groupBy(*keys).agg(F.max("all").alias("n"), F.min(x).alias("upper_median"))
