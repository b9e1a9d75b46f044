"""Queries on vectors, resampling, cross-validation and tracks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions import vectors as vx
from ..operators import metrics as m
from ..operators import models, resample, sampling, shifts, tracks
from ..session import table
from .base import CURVE, SCORED, TOL, TRUTH, Book, curve, r6, scored, truth

book = Book()
WITH = f"WITH {SCORED}"


def rows_count():
    """The number of rows, as an aggregate; made when asked for, as columns need a session."""
    return F.count(F.lit(1))


EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, label, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM e)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def neighbours(spark, d):
    return vectors(spark, d).withColumn("u", F.lead("v").over(W.partitionBy("label").orderBy("vec_id"))).where("u IS NOT NULL")


@book.add("w02_cosine_distance", f"WITH {EMB} SELECT vec_id, round(1 - list_cosine_similarity(v, u), 6) AS distance FROM n WHERE u IS NOT NULL")
def w02(spark, d):
    return neighbours(spark, d).select("vec_id", r6(1 - vx.cosine(F.col("v"), F.col("u"))).alias("distance"))


@book.add("w07_pair_block", f"WITH {EMB} SELECT vec_id, len(v) * 4 AS size, round(list_sum(list_transform(list_zip(v, u), lambda p: abs(p[1] - p[2]))), 5) AS difference, round(list_inner_product(v, u), 6) AS product FROM n WHERE u IS NOT NULL")
def w07(spark, d):
    b = vx.pair_block(F.col("v"), F.col("u"))
    size = F.size("v")
    part = lambda k: F.slice(b, size * k + 1, size)
    return neighbours(spark, d).select("vec_id", F.size(b).cast("long").alias("size"), F.round(vx.total(part(2)), 5).alias("difference"), r6(vx.total(part(3))).alias("product"))


@book.add("p15_w08_blocks", "SELECT vec_id, round(list_sum(list_transform(list_slice(embedding, 17, 32), lambda x: CAST(x AS DOUBLE) * x)), 5) AS energy FROM embeddings")
def p15(spark, d):
    b = vx.block(F.col("v"), 16, 1)
    return vectors(spark, d).select("vec_id", F.round(vx.dot(b, b), 5).alias("energy"))


@book.add("v13_windowed_change", f"WITH {EMB}, x AS (SELECT vec_id, label, i, v[i] AS x FROM e, (SELECT unnest(generate_series(1, 64)) AS i) g), w AS (SELECT vec_id, label, i, avg(x) OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, avg(x) OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS b FROM x) SELECT vec_id, round(sqrt(sum((a - b) * (a - b))), 6) AS change FROM w WHERE a IS NOT NULL GROUP BY vec_id")
def v13(spark, d):
    x = vectors(spark, d).select("vec_id", "label", F.posexplode("v").alias("i", "x"))
    w = W.partitionBy("label", "i").orderBy("vec_id")
    diff = F.avg("x").over(w.rowsBetween(-3, -1)) - F.avg("x").over(w.rowsBetween(0, 2))
    return x.withColumn("c", diff).where("c IS NOT NULL").groupBy("vec_id").agg(r6(F.sqrt(F.sum(F.col("c") ** 2))).alias("change"))


@book.add("w01_hal_features", f"WITH {EMB}, x AS (SELECT vec_id, label, i, v[i] AS x FROM e, (SELECT unnest(generate_series(1, 64)) AS i) g), w AS (SELECT vec_id, i, avg(x) OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l, avg(x) OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS r, var_pop(x) OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lv FROM x) SELECT vec_id, round(1 - sum(l * r) / sqrt(sum(l * l) * sum(r * r)), 6) AS short_change, round(avg(lv), 6) AS left_variance FROM w WHERE l IS NOT NULL GROUP BY vec_id")
def w01(spark, d):
    x = vectors(spark, d).select("vec_id", "label", F.posexplode("v").alias("i", "x"))
    w = W.partitionBy("label", "i").orderBy("vec_id")
    f = x.withColumn("l", F.avg("x").over(w.rowsBetween(-2, -1))).withColumn("r", F.avg("x").over(w.rowsBetween(0, 1))).withColumn("lv", F.var_pop("x").over(w.rowsBetween(-3, -1))).where("l IS NOT NULL")
    l, r = F.col("l"), F.col("r")
    return f.groupBy("vec_id").agg(r6(1 - F.sum(l * r) / F.sqrt(F.sum(l * l) * F.sum(r * r))).alias("short_change"), r6(F.avg("lv")).alias("left_variance"))


@book.add("w09_group_centering", f"WITH {EMB}, x AS (SELECT vec_id, label, i, v[i] AS x FROM e, (SELECT unnest(generate_series(1, 64)) AS i) g), c AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY label, i) AS c FROM x) SELECT vec_id, round(sqrt(sum(c * c)), 6) AS norm FROM c GROUP BY vec_id")
def w09(spark, d):
    x = vectors(spark, d).select("vec_id", "label", F.posexplode("v").alias("i", "x"))
    means = x.groupBy("label", "i").agg(F.avg("x").alias("m"))  # partial sums, then a small join
    return x.join(means, ["label", "i"]).groupBy("vec_id").agg(r6(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2))).alias("norm"))


@book.add("w11_score_map_features", f"{WITH}, g AS (SELECT source, max(s2) FILTER (WHERE y = 1) AS best_gt, max(s2) FILTER (WHERE y = 0) AS best_other, count(*) AS n FROM scored GROUP BY source), z AS (SELECT source, sum(exp(s2)) AS z, sum(exp(s2) * s2) AS zs FROM scored GROUP BY source) SELECT source, round(best_gt - best_other, 6) AS margin, n, round(ln(z) - zs / z, 6) AS entropy FROM g JOIN z USING (source)")
def w11(spark, d):
    top = lambda y: F.max(F.when(F.col("y") == y, F.col("s2")))
    z = F.sum(F.exp("s2"))
    return scored(spark, d).groupBy("source").agg(r6(top(1) - top(0)).alias("margin"), rows_count().alias("n"), r6(F.log(z) - F.sum(F.exp("s2") * F.col("s2")) / z).alias("entropy"))


@book.add("v27_transition_concentration", f"WITH {CURVE}, c AS (SELECT user_id, t, abs(prob - lag(prob) OVER (PARTITION BY user_id ORDER BY t, i)) AS c FROM curve), m AS (SELECT user_id, avg(t) AS mid FROM curve GROUP BY user_id) SELECT user_id, round(sum(CASE WHEN abs(t - mid) <= 259200 THEN c ELSE 0 END) / sum(c), 6) AS share, round(max(c) / quantile_cont(c, 0.5), 4) AS peak_to_median FROM c JOIN m USING (user_id) WHERE c IS NOT NULL GROUP BY user_id")
def v27(spark, d):
    c = curve(spark, d).withColumn("c", F.abs(F.col("prob") - F.lag("prob").over(W.partitionBy("user_id").orderBy("t", "i"))))
    mid = curve(spark, d).groupBy("user_id").agg(F.avg("t").alias("mid"))
    near = F.abs(F.col("t") - F.col("mid")) <= 259200
    return c.join(mid, "user_id").where("c IS NOT NULL").groupBy("user_id").agg(r6(F.sum(F.when(near, F.col("c")).otherwise(0.0)) / F.sum("c")).alias("share"), F.round(F.max("c") / F.percentile("c", 0.5), 4).alias("peak_to_median"))


@book.add("a46_effective_rank")
def a46(spark, d):
    return models.effective_rank(table(spark, d, "embeddings"), "label", "embedding").select("label", "n", F.round("effective_rank", 4).alias("effective_rank"))


@book.add("b06_excess_over_null", f"{WITH}, g AS (SELECT source, sum(CASE WHEN s > s2 THEN 1.0 WHEN s = s2 THEN 0.5 ELSE 0 END) AS w, sum(CASE WHEN s > 0.5 THEN 1.0 ELSE 0 END) AS w0, count(*) AS n FROM scored GROUP BY source) SELECT round(CAST(sum(w) / sum(n) AS DOUBLE), 6) AS observed, round(CAST(sum(w0) / sum(n) AS DOUBLE), 6) AS chance, round(CAST((sum(w) - sum(w0)) / sum(n) AS DOUBLE), 6) AS excess FROM g")
def b06(spark, d):
    win = F.when(F.col("s") > F.col("s2"), 1.0).when(F.col("s") == F.col("s2"), 0.5).otherwise(0.0)
    g = scored(spark, d).groupBy("source").agg(F.sum(win).alias("w"), F.sum((F.col("s") > 0.5).cast("double")).alias("w0"), rows_count().alias("n"))
    return g.agg(r6(F.sum("w") / F.sum("n")).alias("observed"), r6(F.sum("w0") / F.sum("n")).alias("chance"), r6((F.sum("w") - F.sum("w0")) / F.sum("n")).alias("excess"))


SHIFTS = f"c AS (SELECT DISTINCT user_id, t FROM curve WHERE label = 'click'), sp AS (SELECT user_id, min(x) AS lo, max(x) - min(x) AS span FROM (SELECT user_id, t AS x FROM c UNION ALL SELECT user_id, u FROM truth) q GROUP BY user_id HAVING max(x) > min(x)), sh AS (SELECT user_id, lo, span, b, CASE WHEN b < 0 THEN 0 ELSE ((b * 104729 + user_id * 7919 + 1) % 100003) / 100003.0::DOUBLE * span END AS shift FROM sp, (SELECT unnest(generate_series(-1, 49)) AS b) bs), mv AS (SELECT c.user_id, b, c.t AS peak, CASE WHEN b < 0 THEN t ELSE lo + fmod(t - lo + shift, span) END AS t FROM c JOIN sh USING (user_id)), g AS (SELECT DISTINCT user_id, u FROM truth)"
P_VALUE = "SELECT (SELECT hits FROM n WHERE b = -1) AS observed, round(avg(hits), 6) AS null_mean, round((1 + count(*) FILTER (WHERE hits >= (SELECT hits FROM n WHERE b = -1))) / (1.0 + count(*)), 6)::DOUBLE AS p FROM n WHERE b >= 0"


def shift_nulls(spark, d):
    clicks, bounds = curve(spark, d).where("label = 'click'").select("user_id", "t"), truth(spark, d).select("user_id", "u")
    return shifts.circular(clicks, bounds, shifts.spans_of(clicks, bounds), "user_id", "t", "u", TOL / 6, 50)


def p_value(null):
    return resample.p_value(null, "hits").select("observed", r6("null_mean").alias("null_mean"), r6("p").alias("p"))


@book.add("b07_circular_shift_null", f"WITH {CURVE}, {TRUTH}, {SHIFTS}, h AS (SELECT g.user_id, s.b, g.u, count(m.t) > 0 AS hit FROM g JOIN sh s ON s.user_id = g.user_id LEFT JOIN mv m ON m.user_id = g.user_id AND m.b = s.b AND abs(m.t - g.u) <= {TOL / 6} GROUP BY 1, 2, 3), n AS (SELECT b, count(*) FILTER (WHERE hit) AS hits FROM h GROUP BY b) {P_VALUE}")
def b07(spark, d):
    """Boundaries with a peak nearby, against peaks that are turned around their recording."""
    return p_value(shift_nulls(spark, d)[0])


@book.add("b07_peak_centric", f"WITH {CURVE}, {TRUTH}, {SHIFTS}, h AS (SELECT m.user_id, m.b, m.peak, count(g.u) > 0 AS hit FROM mv m LEFT JOIN g ON m.user_id = g.user_id AND abs(m.t - g.u) <= {TOL / 6} GROUP BY 1, 2, 3), n AS (SELECT b, count(*) FILTER (WHERE hit) AS hits FROM h GROUP BY b) {P_VALUE}")
def b07_peaks(spark, d):
    """The same null counted by peaks: those with a boundary nearby."""
    return p_value(shift_nulls(spark, d)[1])


@book.add("b09_derangement", f"{WITH}, s AS (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS k FROM scored), m AS (SELECT max(n) AS most, sum(n) AS n FROM (SELECT count(*) AS n FROM scored GROUP BY source) q) SELECT s.source, s.doc_id, p.source AS source_partner, p.doc_id AS doc_id_partner FROM s, m, s p WHERE p.k = (s.k + most) % m.n")
def b09(spark, d):
    # the hot source is drawn on by at most half of the rows, else the operator raises
    rows = scored(spark, d)
    return resample.derangement(rows, "source", "doc_id")


#: The order of rows in a replicate, and the AUROC of a score against dealt labels, in SQL.
ORDER = "((doc_id % 1000003) * ((b * 7919 + 104729) % 1000003) + (doc_id % 10007) * (doc_id % 10007) * (b + 17)) % 1000003"
DEALT = f"b AS (SELECT unnest(generate_series(0, 39)) AS b), p AS (SELECT b, doc_id, s, s2, CAST(row_number() OVER (PARTITION BY b ORDER BY {ORDER}, doc_id) <= (SELECT sum(y) FROM scored) AS INT) AS y FROM scored, b)"


def auroc_sql(score, table="p"):
    return f"SELECT b, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS a FROM (SELECT b, y, rank() OVER (PARTITION BY b ORDER BY {score}) + (count(*) OVER (PARTITION BY b, {score}) - 1) / 2.0 AS r FROM {table}) q GROUP BY b"


@book.add("b10_label_permutation", f"{WITH}, {DEALT}, a AS ({auroc_sql('s2')}) SELECT round(quantile_cont(greatest(a, 1 - a), 0.95), 6) AS p95 FROM a")
def b10(spark, d):
    p = resample.permuted(scored(spark, d), "doc_id", "y", 40)
    a = m.auroc(p, ["b"], "s2", "y_permuted").withColumn("folded", F.greatest("auroc", 1 - F.col("auroc")))
    return a.agg(r6(F.percentile("folded", 0.95)).alias("p95"))


@book.add("b11_family_wise", f"{WITH}, {DEALT}, a AS ({auroc_sql('s')}), c AS ({auroc_sql('s2')}) SELECT round(quantile_cont(greatest(a.a, 1 - a.a, c.a, 1 - c.a), 0.95), 6) AS p95 FROM a JOIN c USING (b)")
def b11(spark, d):
    p = resample.permuted(scored(spark, d), "doc_id", "y", 40)
    fold = lambda s: m.auroc(p, ["b"], s, "y_permuted").select("b", F.greatest("auroc", 1 - F.col("auroc")).alias(s))
    return fold("s").join(fold("s2"), "b").agg(r6(F.percentile(F.greatest("s", "s2"), 0.95)).alias("p95"))


@book.add("m03_m04_grouped_out_of_fold")
def m04(spark, d):
    rows = scored(spark, d)
    folds = sampling.grouped_folds(rows, "source", 5)
    f = rows.join(folds, "source").select("doc_id", "fold", "y", "s", "s2", F.col("z").cast("double").alias("zz"))
    oof = models.out_of_fold(f, "fold", "doc_id", ["s", "s2", "zz"], "y", 5, components=2)
    return oof.select("doc_id", "fold", F.round("score", 4).alias("score"))


@book.add("m08_per_fold_auroc", f"{WITH}, r AS (SELECT doc_id % 5 AS fold, y, rank() OVER (PARTITION BY doc_id % 5 ORDER BY s2) + (count(*) OVER (PARTITION BY doc_id % 5, s2) - 1) / 2.0 AS r FROM scored) SELECT fold, round(CAST((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS DOUBLE), 6) AS auroc FROM r GROUP BY fold")
def m08(spark, d):
    return m.auroc(scored(spark, d).withColumn("fold", F.col("doc_id") % 5), ["fold"], "s2", "y").select("fold", r6("auroc").alias("auroc"))


@book.add("m09_score_blend", f"{WITH}, r AS (SELECT min(s2) AS lo, max(s2) AS hi FROM scored) SELECT doc_id, round(CASE WHEN doc_id % 17 = 0 THEN s ELSE 0.5 * s + 0.5 * (s2 - lo) / (hi - lo) END, 6) AS blend FROM scored, r")
def m09(spark, d):
    rows = scored(spark, d)
    r = rows.agg(F.min("s2").alias("lo"), F.max("s2").alias("hi"))
    return rows.join(F.broadcast(r)).select("doc_id", r6(F.when(F.col("doc_id") % 17 == 0, F.col("s")).otherwise(0.5 * F.col("s") + 0.5 * (F.col("s2") - F.col("lo")) / (F.col("hi") - F.col("lo")))).alias("blend"))


@book.add("m10_three_way_metrics", f"{WITH} SELECT count(*) FILTER (WHERE s >= 0.6 OR s <= 0.3) AS decided, count(*) FILTER (WHERE s > 0.3 AND s < 0.6) AS review, round((count(*) FILTER (WHERE s >= 0.6 AND y = 1) / CAST(count(*) FILTER (WHERE (s >= 0.6 OR s <= 0.3) AND y = 1) AS DOUBLE) + count(*) FILTER (WHERE s <= 0.3 AND y = 0) / CAST(count(*) FILTER (WHERE (s >= 0.6 OR s <= 0.3) AND y = 0) AS DOUBLE)) / 2, 6) AS balanced FROM scored")
def m10(spark, d):
    keep, drop = F.col("s") >= 0.6, F.col("s") <= 0.3
    good = F.col("y") == 1
    return scored(spark, d).agg(F.count_if(keep | drop).alias("decided"), F.count_if(~keep & ~drop).alias("review"), r6((F.count_if(keep & good) / F.count_if((keep | drop) & good) + F.count_if(drop & ~good) / F.count_if((keep | drop) & ~good)) / 2).alias("balanced"))


@book.add("m06_grouped_threshold", f"{WITH}, e AS (SELECT f AS fold, s, y FROM scored, (SELECT unnest([0, 1, 2, 3, 4]) AS f) q WHERE doc_id % 5 <> f AND s IS NOT NULL), c AS (SELECT fold, s AS tau, count(*) AS all_n FROM e GROUP BY 1, 2), g AS (SELECT c.fold, c.tau, (SELECT count(*) FROM e WHERE e.fold = c.fold AND e.s > c.tau) AS n, (SELECT count(*) FROM e WHERE e.fold = c.fold AND e.s > c.tau AND y = 1) AS tp, (SELECT count(*) FROM e WHERE e.fold = c.fold AND y = 1) AS pos FROM c), f AS (SELECT fold, tau, CASE WHEN n + pos > 0 THEN 2 * tp / CAST(n + pos AS DOUBLE) ELSE 0 END AS f1 FROM g) SELECT fold, round(max(f1), 6) AS best_f1, arg_max(tau, {{'f': round(f1, 9), 't': -tau}}) AS tau FROM f GROUP BY fold")
def m06(spark, d):
    # every fold's threshold from the counts of the other folds
    rows = scored(spark, d).withColumn("own", (F.col("doc_id") % 5).cast("int"))
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> own")
    return m.best_f1(each, ["fold"], "s", "y").select("fold", r6("best_f1").alias("best_f1"), "tau")


def boxes(spark, d):
    """A supplier's line items as boxes in frames of a day."""
    li = table(spark, d, "lineitem")
    day = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86400e6).cast("double")
    x = F.col("l_quantity")
    return li.select(F.col("l_suppkey").alias("rec"), day.alias("t"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box_id"), F.col("l_returnflag").alias("label"), x.alias("x0"), (x / 2).alias("y0"), (x + 30).alias("x1"), (x / 2 + 30).alias("y1"))


@book.add("j18_j19_track_association")
def j19(spark, d):
    return tracks.track(boxes(spark, d), "rec", "t", 3.0)


@book.add("v17_smoothing_in_runs")
def v17(spark, d):
    x = curve(spark, d).select("user_id", "t", F.when(F.col("i") % 7 != 0, F.col("prob")).alias("x"))
    return tracks.smoothed_runs(x, "user_id", "t", "x", 86400.0).withColumn("smooth", r6("smooth"))


@book.add("v22_v25_trajectory_features")
def v22(spark, d):
    c = curve(spark, d).select("user_id", "t", (F.col("prob") / 10).alias("x"), F.sin(F.col("t") / 90000).alias("y"))
    out = tracks.trajectory_features(c, "user_id", "t", "x", "y")
    return out.select("user_id", "n", "reversals", "stops", *[F.round(k, 4).alias(k) for k in ("straightness", "periodicity", "band")])


@book.add("v26_longest_track", f"WITH {CURVE}, c AS (SELECT user_id, label, count(*) AS n, min(i) AS f FROM curve GROUP BY 1, 2) SELECT user_id, arg_max(label, {{'n': n, 'f': -f}}) AS track, max(n) AS n FROM c GROUP BY user_id")
def v26(spark, d):
    c = curve(spark, d).groupBy("user_id", "label").agg(rows_count().alias("n"), F.min("i").alias("f"))
    return c.groupBy("user_id").agg(F.max_by("label", F.struct("n", -F.col("f"))).alias("track"), F.max("n").alias("n"))


@book.add("g05_g06_encodings", f"{WITH} SELECT doc_id, round(1 / (1 + exp(-greatest(least(100 * (s - 0.5), 30), -30))), 6) AS p, CASE WHEN s > 0.6 THEN 1.0 WHEN s < 0.3 THEN 0.0 ELSE 0.5 END::DOUBLE AS code FROM scored")
def g05(spark, d):
    answer = F.when(F.col("s") > 0.6, "yes").when(F.col("s") < 0.3, "no").otherwise("unclear")
    return scored(spark, d).select("doc_id", r6(sc.sigmoid(100 * (F.col("s") - 0.5))).alias("p"), sc.encode_answer(answer).alias("code"))
