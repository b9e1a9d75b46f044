"""Queries on evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import digests
from ..operators import metrics as m
from ..session import table
from .base import SCORED, Book, r6, scored

book = Book()
WITH = f"WITH {SCORED}"


def rows_count():
    """The number of rows, as an aggregate; made when asked for, as columns need a session."""
    return F.count(F.lit(1))


@book.add("a01_auroc", f"{WITH}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r FROM scored) SELECT lang, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg, round(CAST((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS DOUBLE), 6) AS auroc FROM r GROUP BY lang")
def a01(spark, d):
    return m.auroc(scored(spark, d), ["lang"], "s", "y").withColumn("auroc", r6("auroc"))


CURVE_SQL = "c AS (SELECT s, sum(y) AS p, count(*) AS a FROM scored GROUP BY s), k AS (SELECT s, CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(a) OVER w AS DOUBLE) AS n FROM c WINDOW w AS (ORDER BY s DESC))"


@book.add("a02_pr_auc", f"{WITH}, {CURVE_SQL}, z AS (SELECT s, tp / max(tp) OVER () AS r, tp / n AS p FROM k), t AS (SELECT (r - coalesce(lag(r) OVER (ORDER BY s DESC), 0)) * (p + coalesce(lag(p) OVER (ORDER BY s DESC), 1)) / 2 AS a FROM z) SELECT round(sum(a), 6) AS pr_auc FROM t")
def a02(spark, d):
    return m.pr_auc(scored(spark, d), [], "s", "y").select(r6("pr_auc").alias("pr_auc"))


@book.add("a03_binary_prf", f"{WITH}, p AS (SELECT source, y = 1 AS g, s >= 0.5 AS h FROM scored), c AS (SELECT source, count(*) FILTER (WHERE g AND h) AS tp, count(*) FILTER (WHERE NOT g AND h) AS fp, count(*) FILTER (WHERE g AND NOT h) AS fn, count(*) FILTER (WHERE NOT g AND NOT h) AS tn FROM p GROUP BY source) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy FROM c")
def a03(spark, d):
    out = scored(spark, d).groupBy("source").agg(*m.prf(F.col("y") == 1, F.col("s") >= 0.5))
    return out.select("source", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


PRED = "CASE WHEN s >= 0.6 THEN 'keep' WHEN s < 0.2 THEN NULL WHEN s < 0.25 THEN 'odd' ELSE 'drop' END"


def decided(spark, d):
    pred = F.when(F.col("s") >= 0.6, "keep").when(F.col("s") < 0.2, None).when(F.col("s") < 0.25, "odd").otherwise("drop")
    return scored(spark, d).withColumn("gold", F.when(F.col("y") == 1, "keep").otherwise("drop")).withColumn("pred", pred)


@book.add("a04_confusion_matrix", f"{WITH} SELECT CASE WHEN y = 1 THEN 'keep' ELSE 'drop' END AS gold, CASE WHEN ({PRED}) IS NULL THEN '<none>' WHEN ({PRED}) = 'odd' THEN '<invalid>' ELSE ({PRED}) END AS pred, count(*) AS n FROM scored GROUP BY 1, 2")
def a04(spark, d):
    shown = F.when(F.col("pred").isNull(), "<none>").when(~F.col("pred").isin("keep", "drop"), "<invalid>").otherwise(F.col("pred"))
    return decided(spark, d).groupBy("gold", shown.alias("pred")).agg(rows_count().alias("n"))


SETS = "sets AS (SELECT conv_id, list_sort(list_distinct(list(CASE WHEN turn % 2 = 0 THEN role || (length(text) % 5) END))) AS a, list_sort(list_distinct(list(CASE WHEN turn % 2 = 1 THEN 'user' || (length(text) % 5) END))) AS b FROM conversations GROUP BY conv_id)"


def sets(spark, d):
    c = table(spark, d, "conversations")
    part = (F.length("text") % 5).cast("string")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.when(F.col("turn") % 2 == 0, F.concat("role", part)))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("turn") % 2 == 1, F.concat(F.lit("user"), part)))).alias("b"))


@book.add("a05_set_scores", f"WITH {SETS}, x AS (SELECT conv_id, coalesce(list_filter(a, lambda v: v IS NOT NULL), []) AS a, coalesce(list_filter(b, lambda v: v IS NOT NULL), []) AS b FROM sets), y AS (SELECT conv_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS i FROM x) SELECT conv_id, round(CASE WHEN nb > 0 THEN i / CAST(nb AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN na > 0 THEN i / CAST(na AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN na + nb - i > 0 THEN i / CAST(na + nb - i AS DOUBLE) ELSE 0 END, 6) AS jaccard, na = nb AND i = na AS exact FROM y")
def a05(spark, d):
    i, na, nb = F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b")
    return sets(spark, d).select("conv_id", r6(sc.safe_ratio(i, nb)).alias("precision"), r6(sc.safe_ratio(i, na)).alias("recall"), r6(sc.safe_ratio(i, na + nb - i)).alias("jaccard"), ((na == nb) & (i == na)).alias("exact"))


@book.add("a10_percentile_rank", f"{WITH} SELECT source, doc_id, round(cume_dist() OVER (PARTITION BY source ORDER BY s), 6) AS rank FROM scored")
def a10(spark, d):
    return scored(spark, d).select("source", "doc_id", r6(F.cume_dist().over(W.partitionBy("source").orderBy("s"))).alias("rank"))


@book.add("a13_time_error", f"{WITH}, e AS (SELECT lang, abs(s - s2) AS e FROM scored) SELECT lang, count(*) AS n, round(avg(e), 6) AS mae, round(list_sort(list(e))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 6) AS upper_median, round(avg(CASE WHEN e <= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS within FROM e GROUP BY lang")
def a13(spark, d):
    e = scored(spark, d).select("lang", F.abs(F.col("s") - F.col("s2")).alias("e"))
    middle = m.upper_median(e, ["lang"], "e").select(F.col("lang").alias("of"), r6("upper_median").alias("upper_median"))
    means = e.groupBy("lang").agg(rows_count().alias("n"), r6(F.avg("e")).alias("mae"), r6(F.avg((F.col("e") <= 0.25).cast("double"))).alias("within"))
    return means.join(middle, means["lang"].eqNullSafe(middle["of"])).drop("of")


@book.add("a14_calibration_buckets", f"{WITH} SELECT CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS accuracy FROM scored GROUP BY 1")
def a14(spark, d):
    return scored(spark, d).groupBy(sc.bucket(F.col("s"), [0.5, 0.8], ["low", "medium", "high"]).alias("bucket")).agg(rows_count().alias("n"), r6(F.avg("y")).alias("accuracy"))


W_SQL = "round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high"


@book.add("a15_wilson", f"{WITH}, c AS (SELECT source, CAST(sum(y) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY source) SELECT source, {W_SQL} FROM c")
def a15(spark, d):
    c = scored(spark, d).groupBy("source").agg(F.sum("y").cast("double").alias("k"), rows_count().cast("double").alias("n"))
    lo, hi = sc.wilson(F.col("k"), F.col("n"))
    return c.select("source", r6(lo).alias("low"), r6(hi).alias("high"))


@book.add("a16_kappa", f"{WITH}, t AS (SELECT count(*) AS n, CAST(sum(CASE WHEN y = z THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS po, (sum(y) * CAST(sum(z) AS DOUBLE) + (count(*) - sum(y)) * CAST(count(*) - sum(z) AS DOUBLE)) / (count(*) * CAST(count(*) AS DOUBLE)) AS pe FROM scored) SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM t")
def a16(spark, d):
    return m.kappa(scored(spark, d), "y", "z").select("n", r6("observed").alias("observed"), r6("expected").alias("expected"), r6("kappa").alias("kappa"))


@book.add("a17_pair_agreement", f"{WITH} SELECT y, z, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM scored GROUP BY y, z")
def a17(spark, d):
    c = scored(spark, d).groupBy("y", "z").agg(rows_count().alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("all")))).select("y", "z", "n", r6(F.col("n") / F.col("all")).alias("share"))


@book.add("a18_spearman", f"{WITH}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY s2) + (count(*) OVER (PARTITION BY lang, s2) - 1) / 2.0 AS b FROM scored) SELECT lang, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY lang")
def a18(spark, d):
    return m.spearman(scored(spark, d), ["lang"], "s", "s2").select("lang", "n", r6("rho").alias("rho"))


@book.add("a19_pearson", f"{WITH} SELECT lang, round(corr(s, s2), 6) AS r FROM scored GROUP BY lang")
def a19(spark, d):
    return scored(spark, d).groupBy("lang").agg(r6(F.corr("s", "s2")).alias("r"))


ENT = "SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS h FROM"


@book.add("a20_entropy_mutual_information", f"{WITH}, j AS (SELECT source, lang, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY 1, 2), ha AS ({ENT} (SELECT sum(n) AS n FROM j GROUP BY source) q), hb AS ({ENT} (SELECT sum(n) AS n FROM j GROUP BY lang) q), hab AS ({ENT} j) SELECT round(ha.h, 6) AS h_a, round(hab.h - hb.h, 6) AS h_a_given_b, round(ha.h + hb.h - hab.h, 6) AS mutual_information FROM ha, hb, hab")
def a20(spark, d):
    return m.entropies(scored(spark, d), "source", "lang").select(*[r6(c).alias(c) for c in ("h_a", "h_a_given_b", "mutual_information")])


@book.add("a21_functional_dependency", f"{WITH} SELECT source, lang, count(DISTINCT y) AS kinds, count(*) AS n FROM scored GROUP BY 1, 2 HAVING count(DISTINCT y) > 1")
def a21(spark, d):
    return scored(spark, d).groupBy("source", "lang").agg(F.count_distinct("y").alias("kinds"), rows_count().alias("n")).where("kinds > 1")


@book.add("a22_nested_residual_variance", f"{WITH}, r AS (SELECT s - avg(s) OVER (PARTITION BY lang) AS a, s - avg(s) OVER (PARTITION BY lang, source) AS b, s FROM scored) SELECT round(var_pop(s), 6) AS total, round(var_pop(a), 6) AS within_key, round(var_pop(b), 6) AS within_key_source FROM r")
def a22(spark, d):
    rest = lambda *k: F.col("s") - F.avg("s").over(W.partitionBy(*k))
    return scored(spark, d).select("s", rest("lang").alias("a"), rest("lang", "source").alias("b")).agg(r6(F.var_pop("s")).alias("total"), r6(F.var_pop("a")).alias("within_key"), r6(F.var_pop("b")).alias("within_key_source"))


@book.add("a23_between_group_share", f"{WITH}, g AS (SELECT source, count(*) AS n, avg(s) AS a, var_pop(s) AS v FROM scored GROUP BY source HAVING count(*) >= 2), t AS (SELECT sum(n * a) / sum(n) AS mu FROM g) SELECT round(sum(n * (a - mu) * (a - mu)) / (sum(n * (a - mu) * (a - mu)) + sum(n * v)), 6) AS between_share FROM g, t")
def a23(spark, d):
    g = scored(spark, d).groupBy("source").agg(rows_count().alias("n"), F.avg("s").alias("a"), F.var_pop("s").alias("v")).where("n >= 2")
    # sum n (a - mu)^2 = sum n a^2 - (sum n a)^2 / sum n
    between = F.sum(F.col("n") * F.col("a") ** 2) - F.sum(F.col("n") * F.col("a")) ** 2 / F.sum("n")
    return g.agg(r6(between / (between + F.sum(F.col("n") * F.col("v")))).alias("between_share"))


@book.add("a24_group_stats", f"{WITH} SELECT source, count(s) AS n, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.75), 6) AS q75, round(stddev_pop(s), 6) AS std, min(s) AS min, max(s) AS max FROM scored GROUP BY source")
def a24(spark, d):
    q = lambda p: r6(F.percentile("s", p))
    return scored(spark, d).groupBy("source").agg(F.count("s").alias("n"), r6(F.avg("s")).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), r6(F.stddev_pop("s")).alias("std"), F.min("s").alias("min"), F.max("s").alias("max"))


MAD = "med AS (SELECT source, quantile_cont(s, 0.5) AS med FROM scored GROUP BY source), mad AS (SELECT source, med, quantile_cont(abs(s - med), 0.5) AS mad FROM scored JOIN med USING (source) GROUP BY source, med)"


def baseline(rows):
    med = rows.groupBy("source").agg(F.percentile("s", 0.5).alias("med"))
    return rows.join(med, "source").groupBy("source", "med").agg(F.percentile(F.abs(F.col("s") - F.col("med")), 0.5).alias("mad"))


@book.add("a25_median_mad", f"{WITH}, {MAD} SELECT source, round(med, 6) AS median, round(mad * 1.4826, 6) AS mad FROM mad")
def a25(spark, d):
    return baseline(scored(spark, d)).select("source", r6("med").alias("median"), r6(F.col("mad") * 1.4826).alias("mad"))


@book.add("w06_robust_z", f"{WITH}, {MAD} SELECT doc_id, round(least(greatest((s - med) / (mad * 1.4826 + 1e-6), -5), 5), 5) AS z FROM scored JOIN mad USING (source)")
def w06(spark, d):
    rows = scored(spark, d)
    z = (F.col("s") - F.col("med")) / (F.col("mad") * 1.4826 + 1e-6)
    return rows.join(baseline(rows), "source").select("doc_id", F.round(F.least(F.greatest(z, F.lit(-5.0)), F.lit(5.0)), 5).alias("z"))


@book.add("a26_shift_grouping_sets", f"{WITH} SELECT coalesce(source, '<all>') AS scope, y, count(*) AS n, round(avg(s), 6) AS mean, round(avg(CASE WHEN s < 0.1 OR s > 0.9 THEN 1.0 ELSE 0.0 END), 6) AS outside FROM scored GROUP BY GROUPING SETS ((y), (source, y))")
def a26(spark, d):
    out = scored(spark, d).groupingSets([["y"], ["source", "y"]], "source", "y").agg(rows_count().alias("n"), r6(F.avg("s")).alias("mean"), r6(F.avg(((F.col("s") < 0.1) | (F.col("s") > 0.9)).cast("double"))).alias("outside"))
    return out.select(F.coalesce("source", F.lit("<all>")).alias("scope"), "y", "n", "mean", "outside")


@book.add("a27_class_support", f"{WITH} SELECT y, count(*) AS n, count(DISTINCT source) AS recordings FROM scored GROUP BY y")
def a27(spark, d):
    return scored(spark, d).groupBy("y").agg(rows_count().alias("n"), F.count_distinct("source").alias("recordings"))


@book.add("a28_mode_agreement", f"{WITH}, c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM scored GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k, sum(n) OVER (PARTITION BY source) AS t FROM c) SELECT source, lang AS mode, round(n / CAST(t AS DOUBLE), 6) AS agreement FROM r WHERE k = 1")
def a28(spark, d):
    c = scored(spark, d).groupBy("source", "lang").agg(rows_count().alias("n"), F.min("doc_id").alias("f"))
    best = F.max_by(F.struct("lang", "n"), F.struct("n", -F.col("f")))
    return c.groupBy("source").agg(best.alias("b"), F.sum("n").alias("t")).select("source", F.col("b.lang").alias("mode"), r6(F.col("b.n") / F.col("t")).alias("agreement"))


@book.add("a29_median_parseable_time", "WITH t AS (SELECT user_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events) SELECT user_id, round(quantile_cont(v, 0.5), 3) AS median_time FROM t GROUP BY user_id")
def a29(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.percentile(text.try_cast("double"), 0.5), 3).alias("median_time"))


RANKED = f"{WITH}, r AS (SELECT source, y, s2, rank() OVER (PARTITION BY source ORDER BY s2 DESC) AS k FROM scored)"


@book.add("a30_recall_at_k", f"{RANKED}, g AS (SELECT source, min(k) FILTER (WHERE y = 1) AS best, max(s2) FILTER (WHERE y = 1) - max(s2) FILTER (WHERE y = 0) AS margin FROM r GROUP BY source) SELECT count(*) AS n, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN best <= 2 THEN 1.0 ELSE 0.0 END), 6) AS recall_2, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(margin), 6) AS margin, round(avg(CASE WHEN margin < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative FROM g WHERE best IS NOT NULL AND margin IS NOT NULL")
def a30(spark, d):
    r = scored(spark, d).withColumn("k", F.rank().over(W.partitionBy("source").orderBy(F.col("s2").desc())))
    top = lambda y: F.max(F.when(F.col("y") == y, F.col("s2")))
    g = r.groupBy("source").agg(F.min(F.when(F.col("y") == 1, F.col("k"))).alias("best"), (top(1) - top(0)).alias("margin")).where("best IS NOT NULL AND margin IS NOT NULL")
    at = lambda k: r6(F.avg((F.col("best") <= k).cast("double"))).alias(f"recall_{k}")
    return g.agg(rows_count().alias("n"), at(1), at(2), at(3), r6(F.avg("margin")).alias("margin"), r6(F.avg((F.col("margin") < 0).cast("double"))).alias("negative"))


@book.add("a32_selective_metrics", f"{WITH}, dd AS (SELECT y, z, CASE WHEN s >= 0.6 THEN 'keep' WHEN s <= 0.2 THEN 'reject' ELSE 'review' END AS v FROM scored) SELECT count(*) AS n, round(avg(CASE WHEN v <> 'review' THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN v = 'review' THEN 1.0 ELSE 0.0 END), 6) AS review_rate, count(*) FILTER (WHERE v = 'keep' AND y = 0) AS false_keeps, round(count(*) FILTER (WHERE v = 'keep' AND y = 1) / CAST(count(*) FILTER (WHERE v = 'keep') AS DOUBLE), 6) AS clean_precision, round(count(*) FILTER (WHERE v = 'keep' AND y = 1 AND z = 0) / CAST(count(*) FILTER (WHERE v = 'keep') AS DOUBLE), 6) AS full_precision FROM dd")
def a32(spark, d):
    v = F.when(F.col("s") >= 0.6, "keep").when(F.col("s") <= 0.2, "reject").otherwise("review")
    rows = scored(spark, d).withColumn("v", v)
    keep = F.col("v") == "keep"
    share = lambda c: r6(F.avg(c.cast("double")))
    return rows.agg(rows_count().alias("n"), share(F.col("v") != "review").alias("coverage"), share(F.col("v") == "review").alias("review_rate"), F.count_if(keep & (F.col("y") == 0)).alias("false_keeps"), r6(F.count_if(keep & (F.col("y") == 1)) / F.count_if(keep)).alias("clean_precision"), r6(F.count_if(keep & (F.col("y") == 1) & (F.col("z") == 0)) / F.count_if(keep)).alias("full_precision"))


@book.add("a33_risk_coverage", f"{WITH}, x AS (SELECT y, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE s END AS s FROM scored), th AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS t), c AS (SELECT CAST(t AS DOUBLE) AS threshold, CAST(count(*) FILTER (WHERE s >= t) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE s >= t AND y = 1) AS DOUBLE) AS k, count(*) AS total FROM x, th GROUP BY t) SELECT threshold, CAST(n AS BIGINT) AS kept, round(n / total, 6) AS coverage, round(k / n, 6) AS precision, {W_SQL.replace('AS low', 'AS wilson_low').replace('AS high', 'AS wilson_high')} FROM c")
def a33(spark, d):
    rows = scored(spark, d).withColumn("s", F.when(F.col("doc_id") % 7 != 0, F.col("s")))
    out = m.risk_coverage(rows, [0.1, 0.3, 0.5, 0.7, 0.9], "s", "y")
    return out.select("threshold", "kept", *[r6(c).alias(c) for c in ("coverage", "precision", "wilson_low", "wilson_high")])


@book.add("a34_precision_coverage_curve", f"{WITH}, {CURVE_SQL} SELECT s, CAST(n AS BIGINT) AS n, round(tp / n, 6) AS precision, round(n / max(n) OVER (), 6) AS coverage FROM k")
def a34(spark, d):
    c = m.cumulative(scored(spark, d), [], "s", "y")
    total = c.agg(F.max("n").alias("all"))
    return c.join(F.broadcast(total)).select("s", "n", r6(F.col("tp") / F.col("n")).alias("precision"), r6(F.col("n") / F.col("all")).alias("coverage"))


@book.add("a35_best_f1_threshold", f"{WITH}, {CURVE_SQL}, u AS (SELECT s, coalesce(lag(tp) OVER (ORDER BY s DESC), 0) AS tp, coalesce(lag(n) OVER (ORDER BY s DESC), 0) AS n, max(tp) OVER () AS p FROM k), f AS (SELECT s, round(2 * tp / (n + p), 9) AS f1 FROM u) SELECT round(max(f1), 6) AS best_f1, arg_max(s, {{'f': f1, 's': -s}}) AS tau FROM f")
def a35(spark, d):
    return m.best_f1(scored(spark, d), [], "s", "y").select(r6("best_f1").alias("best_f1"), "tau")


@book.add("a36_threshold_for_precision", f"{WITH}, {CURVE_SQL} SELECT min(s) AS threshold, CAST(max(n) AS BIGINT) AS selected, CAST(arg_max(tp, n) AS BIGINT) AS \"right\" FROM k WHERE n >= 10 AND tp / n >= 0.85")
def a36(spark, d):
    return m.threshold_for(scored(spark, d), "s", "y", 0.85, 10)


@book.add("a37_buffered_threshold", f"{WITH}, {CURVE_SQL} SELECT min(s) AS threshold, CAST(max(n) AS BIGINT) AS selected, CAST(arg_max(tp, n) AS BIGINT) AS \"right\" FROM k WHERE n >= 10 AND tp / (n + 1) >= 0.85")
def a37(spark, d):
    return m.threshold_for(scored(spark, d), "s", "y", 0.85, 10, buffer=1)


@book.add("a38_matched_call_count", f"{WITH}, n AS (SELECT count(*) FILTER (WHERE s >= 0.6) AS k FROM scored), r AS (SELECT s2, row_number() OVER (ORDER BY s2 DESC, doc_id) AS r FROM scored) SELECT k, s2 AS threshold FROM r JOIN n ON r = k")
def a38(spark, d):
    return m.kth_largest(scored(spark, d), "s2", F.count_if(F.col("s") >= 0.6))


@book.add("a39_rescues_harms", f"{WITH} SELECT count(*) FILTER (WHERE y = 1 AND s2 >= 0.5 AND s < 0.5) AS rescues, count(*) FILTER (WHERE y = 1 AND s >= 0.5 AND s2 < 0.5) AS losses, count(*) FILTER (WHERE y = 0 AND s2 >= 0.5 AND s < 0.5) AS harms FROM scored")
def a39(spark, d):
    up, down, good = (F.col("s2") >= 0.5) & (F.col("s") < 0.5), (F.col("s") >= 0.5) & (F.col("s2") < 0.5), F.col("y") == 1
    return scored(spark, d).agg(F.count_if(good & up).alias("rescues"), F.count_if(good & down).alias("losses"), F.count_if(~good & up).alias("harms"))


T3 = "CASE WHEN {0} >= 0.66 THEN 'high' WHEN {0} >= 0.33 THEN 'mid' ELSE 'low' END"


@book.add("a40_three_by_three", f"{WITH} SELECT {T3.format('s')} AS a, {T3.format('s2')} AS b, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS valid_rate, list_sort(list(doc_id))[1:3] AS examples FROM scored GROUP BY 1, 2")
def a40(spark, d):
    third = lambda c: sc.bucket(F.col(c), [0.33, 0.66], ["low", "mid", "high"])
    rows = scored(spark, d).withColumn("a", third("s")).withColumn("b", third("s2"))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("a", "b").orderBy("doc_id")))
    return rows.groupBy("a", "b").agg(rows_count().alias("n"), r6(F.avg("y")).alias("valid_rate"), F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("doc_id")))).alias("examples"))


FOLD = "doc_id % 5"


@book.add("a41_worst_fold_delta", f"{WITH}, f AS (SELECT {FOLD} AS fold, avg(CASE WHEN (s >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN (s2 >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS b FROM scored GROUP BY 1) SELECT round(min(b - a), 6) AS worst_delta, round(min(b) - min(a), 6) AS difference_of_worst FROM f")
def a41(spark, d):
    ok = lambda c: F.avg(((F.col(c) >= 0.5) == (F.col("y") == 1)).cast("double"))
    f = scored(spark, d).groupBy((F.col("doc_id") % 5).alias("fold")).agg(ok("s").alias("a"), ok("s2").alias("b"))
    return f.agg(r6(F.min(F.col("b") - F.col("a"))).alias("worst_delta"), r6(F.min("b") - F.min("a")).alias("difference_of_worst"))


@book.add("a48_leave_one_out_prior", f"{WITH}, g AS (SELECT doc_id, y, sum(y) OVER (PARTITION BY source, lang) AS t, count(*) OVER (PARTITION BY source, lang) AS n FROM scored), a AS (SELECT avg(CAST(y AS DOUBLE)) AS p FROM scored) SELECT doc_id, round(CASE WHEN n = 1 THEN p ELSE (t - y) / CAST(n - 1 AS DOUBLE) END, 6) AS prior FROM g, a")
def a48(spark, d):
    rows = scored(spark, d)
    w = W.partitionBy("source", "lang")
    g = rows.withColumn("t", F.sum("y").over(w)).withColumn("n", rows_count().over(w))
    overall = rows.agg(F.avg("y").alias("p"))
    return g.join(F.broadcast(overall)).select("doc_id", r6(F.when(F.col("n") == 1, F.col("p")).otherwise((F.col("t") - F.col("y")) / (F.col("n") - 1))).alias("prior"))


@book.add("a49_source_coverage", f"{WITH} SELECT count(*) FILTER (WHERE a > 0) AS has_a, count(*) FILTER (WHERE b > 0) AS has_b, count(*) FILTER (WHERE a > 0 AND b > 0) AS has_both, count(*) AS has_any FROM (SELECT source, count(*) FILTER (WHERE lang = 'es') AS a, count(*) FILTER (WHERE z = 1) AS b FROM scored GROUP BY source HAVING count(*) FILTER (WHERE lang = 'es') > 0 OR count(*) FILTER (WHERE z = 1) > 0) q")
def a49(spark, d):
    a, b = F.col("a") > 0, F.col("b") > 0
    g = scored(spark, d).groupBy("source").agg(F.count_if(F.col("lang") == "es").alias("a"), F.count_if(F.col("z") == 1).alias("b")).where(a | b)
    return g.agg(F.count_if(a).alias("has_a"), F.count_if(b).alias("has_b"), F.count_if(a & b).alias("has_both"), rows_count().alias("has_any"))


@book.add("a50_fingerprint", f"{WITH} SELECT source, substr(sha256(array_to_string(list_sort(list_distinct(list(CAST(doc_id AS VARCHAR)))), chr(31)) || chr(31)), 1, 16) AS fingerprint FROM scored GROUP BY source")
def a50(spark, d):
    return digests.fingerprints(scored(spark, d), "source", "doc_id")


CHECKS = {"score": "s < 0.4", "second": "s2 < 0.3", "toxic": "z = 1", "short": "n_chars < 300"}


def failures(spark, d):
    rows = scored(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.withColumn("fails", F.array_compact(F.array(*[F.when(F.expr(c), k) for k, c in CHECKS.items()])))


FAILS = f"{WITH}, fails AS (SELECT scored.*, list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{k}{chr(39)} END' for k, c in CHECKS.items())}], lambda x: x IS NOT NULL) AS fails FROM scored JOIN documents USING (doc_id))"


@book.add("a51_rule_ablation", f"{FAILS}, c AS (SELECT unnest(['score', 'second', 'toxic', 'short']) AS dropped) SELECT dropped, count(*) FILTER (WHERE y = 1 AND ok) AS true_admits, count(*) FILTER (WHERE y = 0 AND ok) AS false_admits FROM (SELECT dropped, y, len(list_filter(fails, lambda f: f <> dropped)) = 0 AS ok FROM fails, c) q GROUP BY dropped")
def a51(spark, d):
    each = failures(spark, d).withColumn("dropped", F.explode(F.array(*[F.lit(k) for k in CHECKS])))
    ok = F.size(F.filter("fails", lambda f: f != F.col("dropped"))) == 0
    return each.groupBy("dropped").agg(F.count_if(ok & (F.col("y") == 1)).alias("true_admits"), F.count_if(ok & (F.col("y") == 0)).alias("false_admits"))


@book.add("a52_blocker_margins", f"{FAILS} SELECT CAST(len(fails) AS INTEGER) AS away, count(*) AS n, list_sort(list_distinct(flatten(list(fails)))) AS blockers FROM fails GROUP BY 1")
def a52(spark, d):
    f = failures(spark, d)
    n = f.groupBy(F.size("fails").alias("away")).agg(rows_count().alias("n"))
    who = f.select(F.size("fails").alias("away"), F.explode_outer("fails").alias("b")).groupBy("away").agg(F.array_sort(F.collect_set("b")).alias("blockers"))
    return n.join(who, "away")


@book.add("a53_reportable_recall", f"{WITH}, p AS (SELECT lang, source, CASE WHEN s2 < 0.7 THEN lang ELSE 'en' END AS h FROM scored), c AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS r, avg(CASE WHEN h = lang THEN 1.0 ELSE 0.0 END) AS recall FROM p GROUP BY lang) SELECT count(*) AS classes, round(avg(recall), 6) AS macro_recall, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS majority FROM c WHERE n >= 30 AND r >= 5")
def a53(spark, d):
    h = F.when(F.col("s2") < 0.7, F.col("lang")).otherwise("en")
    c = scored(spark, d).groupBy("lang").agg(rows_count().alias("n"), F.count_distinct("source").alias("r"), F.avg((h == F.col("lang")).cast("double")).alias("recall")).where("n >= 30 AND r >= 5")
    return c.agg(rows_count().alias("classes"), r6(F.avg("recall")).alias("macro_recall"), r6(F.max("n") / F.sum("n")).alias("majority"))


@book.add("a55_relabel_impact", f"{WITH}, o AS (SELECT doc_id, y AS old, CASE WHEN doc_id % 11 = 0 THEN 1 - y WHEN doc_id % 13 = 0 THEN NULL ELSE y END AS new FROM scored) SELECT count(*) FILTER (WHERE new IS NULL) AS left_set, count(*) FILTER (WHERE new <> old) AS flipped, round(avg(CAST(old AS DOUBLE)), 6) AS rate_before, round(avg(CAST(new AS DOUBLE)), 6) AS rate_after FROM o")
def a55(spark, d):
    new = F.when(F.col("doc_id") % 11 == 0, 1 - F.col("y")).when(F.col("doc_id") % 13 == 0, None).otherwise(F.col("y"))
    o = scored(spark, d).withColumn("new", new)
    return o.agg(F.count_if(F.col("new").isNull()).alias("left_set"), F.count_if(F.col("new") != F.col("y")).alias("flipped"), r6(F.avg("y")).alias("rate_before"), r6(F.avg("new")).alias("rate_after"))


@book.add("a56_oracle_threshold_accuracy", f"{WITH}, {CURVE_SQL}, t AS (SELECT max(tp) AS p, max(n) AS n FROM k) SELECT round(max((k.tp + (t.n - t.p) - (k.n - k.tp)) / t.n), 6) AS accuracy FROM k, t")
def a56(spark, d):
    c = m.cumulative(scored(spark, d), [], "s", "y")
    t = c.agg(F.max("tp").alias("p"), F.max("n").alias("all"))
    return c.join(F.broadcast(t)).agg(r6(F.max((F.col("tp") + F.col("all") - F.col("p") - F.col("fp")) / F.col("all"))).alias("accuracy"))


@book.add("a57_subtype_false_positives", f"{WITH}, cut AS (SELECT quantile_cont(s, 0.5) AS c FROM scored WHERE y = 1) SELECT lang, count(*) AS n, round(avg(CASE WHEN s >= c THEN 1.0 ELSE 0.0 END), 6) AS false_positive_rate FROM scored, cut WHERE y = 0 GROUP BY lang")
def a57(spark, d):
    rows = scored(spark, d)
    cut = rows.where("y = 1").agg(F.percentile("s", 0.5).alias("c"))
    return rows.where("y = 0").join(F.broadcast(cut)).groupBy("lang").agg(rows_count().alias("n"), r6(F.avg((F.col("s") >= F.col("c")).cast("double"))).alias("false_positive_rate"))


PAIRS = f"{WITH}, r AS (SELECT source, y, s, row_number() OVER (PARTITION BY source, y ORDER BY doc_id) AS k FROM scored), p AS (SELECT a.source, a.s AS sa, b.s AS sb FROM r a JOIN r b ON a.source = b.source AND a.k = b.k AND a.y = 1 AND b.y = 0)"


@book.add("a58_matched_pair_wins", f"{PAIRS} SELECT count(*) AS n, round(avg(CASE WHEN sa > sb THEN 1.0 WHEN sa = sb THEN 0.5 ELSE 0.0 END), 6) AS win_rate FROM p")
def a58(spark, d):
    r = scored(spark, d).withColumn("k", F.row_number().over(W.partitionBy("source", "y").orderBy("doc_id")))
    a = r.where("y = 1").select("source", "k", F.col("s").alias("sa"))
    b = r.where("y = 0").select("source", "k", F.col("s").alias("sb"))
    return a.join(b, ["source", "k"]).agg(rows_count().alias("n"), r6(F.avg(F.when(F.col("sa") > F.col("sb"), 1.0).when(F.col("sa") == F.col("sb"), 0.5).otherwise(0.0))).alias("win_rate"))


@book.add("j26_within_group_pairs", f"{WITH}, g AS (SELECT source, sum(y) AS p, count(*) - sum(y) AS n FROM scored GROUP BY source) SELECT source, CAST(p * n AS BIGINT) AS pairs FROM g WHERE p * n > 0")
def j26(spark, d):
    g = scored(spark, d).groupBy("source").agg((F.sum("y") * (rows_count() - F.sum("y"))).alias("pairs"))
    return g.where("pairs > 0")


@book.add("j27_pooled_pairs_auroc", f"{WITH}, r AS (SELECT y, rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2.0 AS r FROM scored) SELECT round(CAST((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS DOUBLE), 6) AS auroc FROM r")
def j27(spark, d):
    return m.auroc(scored(spark, d), [], "s2", "y").select(r6("auroc").alias("auroc"))


@book.add("a42_vocabulary", "WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) SELECT w AS word, count(*) AS n, count(DISTINCT item_id) AS items FROM w GROUP BY w HAVING count(*) >= 3")
def a42(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(rows_count().alias("n"), F.count_distinct("item_id").alias("items")).where("n >= 3")
