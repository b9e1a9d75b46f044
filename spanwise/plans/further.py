"""Further queries of the inventory: joins, samples, rules and nulls that the other modules leave."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions import text as tx
from ..operators import graph, intervals, metrics, models, reconcile, resample, rules, sampling, shifts, signal
from ..operators.ordering import numbered
from ..session import table
from .base import CURVE, GAP, HOUR, SCORED, SEGMENTS, TOL, TRUTH, Book, curve, r6, scored, segments, truth
from .modelling import ORDER, auroc_sql
from .temporal import PEAKS, decoded, iou_candidates, peaks

book = Book()
WITH = f"WITH {SCORED}"
TIME = f"WITH {SEGMENTS}, {TRUTH}"


def rows_count():
    """The number of rows, as an aggregate; made when asked for, as columns need a session."""
    return F.count(F.lit(1))


U = ["user_id"]


@book.add("j02_composite_key_join", f"{TIME}, p AS (SELECT user_id, seg, e - s AS length FROM segments WHERE seg % 2 = 0) SELECT user_id, seg, label, round(length, 6) AS length FROM segments JOIN p USING (user_id, seg)")
def j02(spark, d):
    s = segments(spark, d)
    p = s.where("seg % 2 = 0").select("user_id", "seg", r6(F.col("e") - F.col("s")).alias("length"))
    return s.select("user_id", "seg", "label").join(p, ["user_id", "seg"])


@book.add("j17_best_iou_per_prediction", f"{TIME}, c AS (SELECT a.user_id, a.seg AS p, b.seg AS g, round(greatest(least(a.e + 10800, b.e) - greatest(a.s, b.s - 10800), 0) / (greatest(a.e + 10800, b.e) - least(a.s, b.s - 10800)), 9) AS iou FROM segments a JOIN segments b ON a.user_id = b.user_id AND a.label = 'view' AND b.label = 'click' AND b.s - 10800 <= a.e + 10800 AND b.e >= a.s) SELECT user_id, p, arg_max(g, {{'i': iou, 'g': -g}}) AS g, max(iou) AS iou FROM c GROUP BY user_id, p")
def j17(spark, d):
    return iou_candidates(spark, d).groupBy("user_id", "p").agg(F.max_by("g", F.struct("iou", -F.col("g"))).alias("g"), F.max("iou").alias("iou"))


@book.add("j25_regression_guard", f"{WITH}, a AS (SELECT doc_id, y FROM scored), b AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 1 - y ELSE y END AS y FROM scored) SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) q UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) q")
def j25(spark, d):
    a = scored(spark, d).select("doc_id", "y")
    b = a.withColumn("y", F.when(F.col("doc_id") % 50 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    return reconcile.symmetric_difference(a, b).groupBy("side").agg(rows_count().alias("n"))


@book.add("j28_shared_events", f"{WITH}, a AS (SELECT doc_id, s FROM scored WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, s2 FROM scored WHERE doc_id % 5 <> 0) SELECT doc_id, s, round(s2, 6) AS s2 FROM a JOIN b USING (doc_id)")
def j28(spark, d):
    rows = scored(spark, d)
    return rows.where("doc_id % 3 <> 0").select("doc_id", "s").join(rows.where("doc_id % 5 <> 0").select("doc_id", r6("s2").alias("s2")), "doc_id")


@book.add("a06_restricted_recall", "WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a FROM benchmark), p AS (SELECT x.item_id, list_slice(list_sort(x.a), 1, 1 + x.item_id % 4) AS g, y.a AS h FROM t x JOIN t y ON y.item_id = x.item_id + 1) SELECT count(*) AS n, round(avg(len(list_intersect(g, h)) / CAST(len(g) AS DOUBLE)), 6) AS recall FROM p WHERE len(g) >= 2")
def a06(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("a"))
    nxt = t.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("h"))
    p = t.join(nxt, "item_id").withColumn("g", F.slice(F.array_sort("a"), F.lit(1), (1 + F.col("item_id") % 4).cast("int"))).where("size(g) >= 2")
    return p.agg(rows_count().alias("n"), r6(F.avg(F.size(F.array_intersect("g", "h")) / F.size("g"))).alias("recall"))


@book.add("a09_name_reward", "WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a FROM conversations), p AS (SELECT x.conv_id, x.turn, len(list_intersect(x.a, y.a)) / CAST(greatest(len(x.a) + len(y.a) - len(list_intersect(x.a, y.a)), 1) AS DOUBLE) AS sim, y.turn AS o FROM t x JOIN t y ON x.conv_id = y.conv_id), r AS (SELECT conv_id, turn, max(sim) FILTER (WHERE o = turn + 1) AS own, max(sim) FILTER (WHERE o <> turn + 1 AND o <> turn) AS other FROM p GROUP BY conv_id, turn) SELECT conv_id, turn, round(greatest(0, own - 0.5 * coalesce(other, 0)), 6) AS reward FROM r WHERE own IS NOT NULL")
def a09(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(tx.tokens(F.col("text"))).alias("a"))
    p = t.join(t.select("conv_id", F.col("turn").alias("o"), F.col("a").alias("b")), "conv_id")  # turns of one conversation
    both = F.size(F.array_intersect("a", "b"))
    p = p.withColumn("sim", both / F.greatest(F.size("a") + F.size("b") - both, F.lit(1)))
    nxt = F.col("o") == F.col("turn") + 1
    r = p.groupBy("conv_id", "turn").agg(F.max(F.when(nxt, F.col("sim"))).alias("own"), F.max(F.when(~nxt & (F.col("o") != F.col("turn")), F.col("sim"))).alias("other")).where("own IS NOT NULL")
    return r.select("conv_id", "turn", r6(F.greatest(F.lit(0.0), F.col("own") - 0.5 * F.coalesce("other", F.lit(0.0)))).alias("reward"))


@book.add("a44_outlier_recordings", f"WITH {CURVE}, m AS (SELECT user_id, count(*) FILTER (WHERE label = 'error') AS errors, count(*) AS n FROM curve GROUP BY user_id) SELECT user_id, errors, n FROM (SELECT *, row_number() OVER (ORDER BY errors DESC, user_id) AS k FROM m) q WHERE k <= 5")
def a44(spark, d):
    m = curve(spark, d).groupBy("user_id").agg(F.count_if(F.col("label") == "error").alias("errors"), rows_count().alias("n"))
    return m.orderBy(F.col("errors").desc(), "user_id").limit(5)


@book.add("a47_binomial_test")
def a47(spark, d):
    win = scored(spark, d).agg(F.count_if(F.col("s") > F.col("s2")).alias("k"), F.count_if(F.col("s") != F.col("s2")).alias("n")).first()
    return spark.createDataFrame([(win["k"], win["n"], round(models.binomial_two_sided(win["k"], win["n"]), 6))], "k long, n long, p double")


@book.add("a54_two_way_distance", f"{TIME}, clicks AS (SELECT user_id, t FROM curve WHERE label = 'click'), a AS (SELECT g.user_id, g.g, min(abs(c.t - g.u)) AS d FROM truth g JOIN clicks c ON c.user_id = g.user_id GROUP BY 1, 2), b AS (SELECT c.user_id, c.t, min(abs(c.t - g.u)) AS d FROM clicks c JOIN truth g ON c.user_id = g.user_id GROUP BY 1, 2) SELECT (SELECT round(avg(d), 3) FROM a) AS old_to_new, (SELECT round(avg(d), 3) FROM b) AS new_to_old, (SELECT round(avg(CASE WHEN d <= {TOL} THEN 1.0 ELSE 0.0 END), 6) FROM a) AS agreement")
def a54(spark, d):
    clicks = curve(spark, d).where("label = 'click'").select("user_id", "t", "i")
    g = truth(spark, d)
    a = intervals.nearest(g, clicks, U, "u", "t", ["g"], ["i"]).where("distance IS NOT NULL").agg(F.round(F.avg("distance"), 3).alias("old_to_new"), r6(F.avg((F.col("distance") <= TOL).cast("double"))).alias("agreement"))
    b = intervals.nearest(clicks, g, U, "t", "u", ["i"], ["g"]).where("distance IS NOT NULL").agg(F.round(F.avg("distance"), 3).alias("new_to_old"))
    return a.join(b)


@book.add("v06_change_peaks", f"WITH {CURVE}, c AS (SELECT user_id, i, t, abs(prob - lag(prob) OVER (PARTITION BY user_id ORDER BY t, i)) AS c FROM curve), q AS (SELECT user_id, quantile_cont(c, 0.9) AS q FROM c GROUP BY user_id), l AS (SELECT user_id, list({{'s': -c, 'i': i, 't': t}} ORDER BY -c, i) AS p FROM c JOIN q USING (user_id) WHERE c >= q GROUP BY user_id), f AS (SELECT user_id, list_reduce(list_transform(p, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k.t - x[1].t) < {GAP})) = 0 THEN list_concat(acc, x) ELSE acc END) AS kept FROM l) SELECT user_id, k.i AS i, k.t AS t FROM (SELECT user_id, unnest(kept) AS k FROM f) z")
def v06(spark, d):
    c = curve(spark, d).withColumn("c", F.abs(F.col("prob") - F.lag("prob").over(W.partitionBy("user_id").orderBy("t", "i")))).where("c IS NOT NULL")
    return signal.suppress(signal.with_quantile(c, U, "c", 0.9, "q").where("c >= q"), U, "t", "i", "c", GAP).select("user_id", "i", "t")


@book.add("v07_segments_from_cuts", f"WITH {PEAKS}, k AS (SELECT user_id, unnest(kept) AS k FROM folded), b AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM curve GROUP BY user_id), p AS (SELECT DISTINCT user_id, x FROM (SELECT user_id, k.t AS x FROM k UNION ALL SELECT user_id, lo FROM b UNION ALL SELECT user_id, hi FROM b) q), s AS (SELECT user_id, x AS s, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS e FROM p) SELECT user_id, s, e FROM s WHERE e IS NOT NULL")
def v07(spark, d):
    b = curve(spark, d).groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    points = decoded(spark, d).select("user_id", F.col("t").alias("s")).union(b.select("user_id", "lo")).union(b.select("user_id", "hi")).distinct()
    return points.withColumn("e", F.lead("s").over(W.partitionBy("user_id").orderBy("s"))).where("e IS NOT NULL")


@book.add("v23_stop_start", f"WITH {CURVE} SELECT user_id, round(avg(CASE WHEN t < 1296000 THEN prob END), 6) AS before, round(avg(CASE WHEN t >= 1296000 THEN prob END), 6) AS after, count(*) FILTER (WHERE prob < 5) AS stops FROM curve GROUP BY user_id")
def v23(spark, d):
    early = F.col("t") < 1296000
    return curve(spark, d).groupBy("user_id").agg(r6(F.avg(F.when(early, F.col("prob")))).alias("before"), r6(F.avg(F.when(~early, F.col("prob")))).alias("after"), F.count_if(F.col("prob") < 5).alias("stops"))


@book.add("v30_time_window_smoothing", f"WITH {CURVE}, m AS (SELECT user_id, i, CAST(floor(t) AS BIGINT) AS sec, prob FROM curve) SELECT user_id, i, round(avg(prob) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING), 6) AS smooth FROM m")
def v30(spark, d):
    m = curve(spark, d).withColumn("sec", F.floor("t"))
    return m.select("user_id", "i", r6(F.avg("prob").over(W.partitionBy("user_id").orderBy("sec").rangeBetween(-43200, 43200))).alias("smooth"))


@book.add("w03_w05_multi_scale_means", f"{TIME}, sc AS (SELECT unnest([6, 12, 24]) AS h), l AS (SELECT g.user_id, g.g, sc.h, avg(c.prob) FILTER (WHERE c.t >= g.u - sc.h * 3600 AND c.t < g.u) AS a, avg(c.prob) FILTER (WHERE c.t >= g.u AND c.t < g.u + sc.h * 3600) AS b FROM truth g CROSS JOIN sc JOIN curve c ON c.user_id = g.user_id AND abs(c.t - g.u) <= sc.h * 3600 GROUP BY 1, 2, 3) SELECT user_id, g, CAST(h AS INTEGER) AS h, round(a, 6) AS left_mean, round(b, 6) AS right_mean FROM l")
def w03(spark, d):
    pairs = intervals.tolerance_join(truth(spark, d), curve(spark, d).select("user_id", "t", "prob"), U, "u", "t", 24 * HOUR)
    each = pairs.withColumn("h", F.explode(F.array(*[F.lit(h) for h in (6, 12, 24)])))
    o = F.col("t") - F.col("u")
    near = each.where(F.abs(o) <= F.col("h") * HOUR)
    left, right = (o < 0) & (o >= -F.col("h") * HOUR), (o >= 0) & (o < F.col("h") * HOUR)
    return near.groupBy("user_id", "g", "h").agg(r6(F.avg(F.when(left, F.col("prob")))).alias("left_mean"), r6(F.avg(F.when(right, F.col("prob")))).alias("right_mean"))


@book.add("w04_relative_features", f"{TIME}, r AS (SELECT g.user_id, g.g, count(o.g) AS near, min(abs(o.u - g.u)) AS nearest FROM truth g LEFT JOIN truth o ON o.user_id = g.user_id AND o.g <> g.g AND abs(o.u - g.u) <= 86400 GROUP BY 1, 2) SELECT user_id, g, near, round(coalesce(nearest, 999), 6) AS nearest, near > 0 AS contaminated FROM r")
def w04(spark, d):
    g = truth(spark, d)
    other = g.select("user_id", F.col("g").alias("o"), F.col("u").alias("v"))
    pairs = intervals.tolerance_join(g, other, U, "u", "v", 24 * HOUR, "left").withColumn("d", F.when(F.col("o") != F.col("g"), F.abs(F.col("v") - F.col("u"))))
    return pairs.groupBy("user_id", "g").agg(F.count("d").alias("near"), r6(F.coalesce(F.min("d"), F.lit(999.0))).alias("nearest")).withColumn("contaminated", F.col("near") > 0)


@book.add("l01_policy_order", f"{WITH} SELECT source, n, rate FROM (SELECT source, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS rate, row_number() OVER (ORDER BY count(*) DESC, avg(CAST(y AS DOUBLE)) DESC, source) AS k FROM scored GROUP BY source) q WHERE k = 1")
def l01(spark, d):
    g = scored(spark, d).groupBy("source").agg(rows_count().alias("n"), F.avg("y").alias("rate"))
    return g.orderBy(F.col("n").desc(), F.col("rate").desc(), "source").limit(1).select("source", "n", r6("rate").alias("rate"))


@book.add("l04_stratified_round_robin", f"{WITH}, z AS (SELECT lang, count(*) AS size FROM scored GROUP BY lang), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id * 7919 % 1009, doc_id) AS depth FROM scored) SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY depth, size DESC, lang) AS k FROM r JOIN z USING (lang) WHERE depth <= 12) q WHERE k <= 40")
def l04(spark, d):
    rows = scored(spark, d)
    size = rows.groupBy("lang").agg(rows_count().alias("size"))
    depth = F.row_number().over(W.partitionBy("lang").orderBy(sampling.draw("doc_id"), "doc_id"))
    return rows.withColumn("depth", depth).where("depth <= 12").join(size, "lang").orderBy("depth", F.col("size").desc(), "lang").limit(40).select("doc_id", "lang")


@book.add("l08_key_stride_shard", f"{WITH} SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM scored) q WHERE k % 4 = 1")
def l08(spark, d):
    from ..sources.sinks import shard

    return shard(scored(spark, d).select("doc_id"), "doc_id", 1, 4)


@book.add("l11_recording_split", f"{WITH}, g AS (SELECT source, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM scored) q) SELECT doc_id, CASE WHEN k % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM scored JOIN g USING (source)")
def l11(spark, d):
    rows = scored(spark, d)
    g = numbered(rows.select("source").distinct(), "source").withColumn("k", F.col("place") + 1)
    return rows.join(g, "source").select("doc_id", F.when(F.col("k") % 5 == 0, "val").otherwise("train").alias("split"))


@book.add("l12_uniform_samples", f"WITH {CURVE}, b AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM curve GROUP BY user_id), k AS (SELECT user_id, lo, hi, unnest([0, 1, 2, 3, 4]) AS k FROM b) SELECT user_id, k, round(lo + (k + 0.5) * (hi - lo) / 5, 3) AS t FROM k")
def l12(spark, d):
    b = curve(spark, d).groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return b.select("user_id", "k", F.round(F.col("lo") + (F.col("k") + 0.5) * (F.col("hi") - F.col("lo")) / 5, 3).alias("t"))


@book.add("l14_sub_window_decision", f"WITH {CURVE}, w AS (SELECT user_id, CAST(floor(t / 604800) AS BIGINT) AS w, round(avg(prob) - 40, 6) AS margin FROM curve GROUP BY 1, 2) SELECT user_id, arg_max(margin, {{'m': abs(margin), 'w': -w}}) AS margin, arg_max(margin, {{'m': abs(margin), 'w': -w}}) > 0 AS accept FROM w GROUP BY user_id")
def l14(spark, d):
    w = curve(spark, d).groupBy("user_id", F.floor(F.col("t") / 604800).alias("w")).agg(r6(F.avg("prob") - 40).alias("margin"))
    best = F.max_by("margin", F.struct(F.abs("margin"), -F.col("w")))
    return w.groupBy("user_id").agg(best.alias("margin")).withColumn("accept", F.col("margin") > 0)


@book.add("l16_equal_cells_refill", f"{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY lang, y ORDER BY doc_id * 7919 % 1009, doc_id) AS k FROM scored), o AS (SELECT *, row_number() OVER (ORDER BY doc_id * 7919 % 1009, doc_id) AS q FROM r WHERE k > 5) SELECT doc_id, lang, y, 'cell' AS arm FROM r WHERE k <= 5 UNION ALL SELECT doc_id, lang, y, 'refill' FROM o WHERE q <= 10")
def l16(spark, d):
    rows = scored(spark, d)
    first = sampling.per_group(rows, ["lang", "y"], [sampling.draw("doc_id"), "doc_id"], 5)
    rest = rows.join(first.select("doc_id"), "doc_id", "left_anti").orderBy(sampling.draw("doc_id"), "doc_id").limit(10)
    return first.select("doc_id", "lang", "y", F.lit("cell").alias("arm")).unionByName(rest.select("doc_id", "lang", "y", F.lit("refill").alias("arm")))


@book.add("l17_pool_by_yield", f"{WITH}, p AS (SELECT lang, round(avg(CAST(1 - y AS DOUBLE)), 9) AS yield FROM scored GROUP BY lang), r AS (SELECT doc_id, lang, yield, row_number() OVER (ORDER BY yield DESC, doc_id * 7919 % 1009, doc_id) AS k FROM scored JOIN p USING (lang)) SELECT lang, count(*) AS n, round(sum(yield), 6) AS projected FROM r WHERE k <= 60 GROUP BY lang")
def l17(spark, d):
    rows = scored(spark, d)
    p = rows.groupBy("lang").agg(F.round(F.avg(1 - F.col("y")), 9).alias("yield"))
    return rows.join(p, "lang").orderBy(F.col("yield").desc(), sampling.draw("doc_id"), "doc_id").limit(60).groupBy("lang").agg(rows_count().alias("n"), r6(F.sum("yield")).alias("projected"))


@book.add("l18_three_arm_sample", f"{WITH}, a AS (SELECT doc_id, 'disagree' AS arm FROM scored WHERE (s >= 0.5) <> (y = 1) AND z = 1), r AS (SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY doc_id * 7919 % 1009, doc_id) AS k, y FROM scored WHERE doc_id NOT IN (SELECT doc_id FROM a)) SELECT doc_id, arm FROM a UNION ALL SELECT doc_id, CASE WHEN y = 1 THEN 'fresh' ELSE 'control' END FROM r WHERE k <= 8")
def l18(spark, d):
    rows = scored(spark, d)
    a = rows.where(((F.col("s") >= 0.5) != (F.col("y") == 1)) & (F.col("z") == 1)).select("doc_id", F.lit("disagree").alias("arm"))
    rest = sampling.per_group(rows.join(a, "doc_id", "left_anti"), ["y"], [sampling.draw("doc_id"), "doc_id"], 8)
    return a.unionByName(rest.select("doc_id", F.when(F.col("y") == 1, "fresh").otherwise("control").alias("arm")))


@book.add("r02_r03_fused_fields", f"{WITH} SELECT doc_id, CASE WHEN lang IS NULL THEN 'uncertain' WHEN lang = 'en' AND y = 1 THEN 'same' WHEN lang = 'es' THEN 'too_coarse' WHEN y = 0 THEN 'incompatible' ELSE 'compatible' END AS naming, CASE WHEN z = 1 THEN 'discard' WHEN y = 1 AND s >= 0.5 THEN 'keep' ELSE 'relabel' END AS action FROM scored")
def r02(spark, d):
    lang, y, z = F.col("lang"), F.col("y"), F.col("z")
    naming = F.when(lang.isNull(), "uncertain").when((lang == "en") & (y == 1), "same").when(lang == "es", "too_coarse").when(y == 0, "incompatible").otherwise("compatible")
    return scored(spark, d).select("doc_id", naming.alias("naming"), F.when(z == 1, "discard").when((y == 1) & (F.col("s") >= 0.5), "keep").otherwise("relabel").alias("action"))


@book.add("r05_morphology_masks", f"{WITH} SELECT doc_id, CASE WHEN z = 1 THEN NULL WHEN lang = 'en' THEN 'sharp' WHEN lang = 'de' THEN 'gradual' END AS morphology, CASE WHEN z = 1 THEN 'toxic' WHEN lang NOT IN ('en', 'de') THEN 'no_mapping' END AS mask_reason FROM scored")
def r05(spark, d):
    mapped = F.try_element_at(tx.dictionary({"en": "sharp", "de": "gradual"}), F.col("lang"))
    reason = rules.first_reason([("toxic", F.col("z") == 1), ("no_mapping", mapped.isNull())])
    return scored(spark, d).select("doc_id", F.when(F.col("z") != 1, mapped).alias("morphology"), reason.alias("mask_reason"))


@book.add("r13_ontology_policy", f"{WITH} SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'blocked' WHEN z = 1 THEN 'nuisance' WHEN s >= 0.7 AND lang <> 'es' THEN 'keep' WHEN s >= 0.5 THEN 'blocked_action:retime' ELSE 'review' END AS decision FROM scored")
def r13(spark, d):
    c = F.col
    spec = [("blocked", c("doc_id") % 17 == 0), ("nuisance", c("z") == 1), ("keep", (c("s") >= 0.7) & (c("lang") != "es")), ("blocked_action:retime", c("s") >= 0.5)]
    return scored(spark, d).select("doc_id", F.coalesce(rules.first_reason(spec), F.lit("review")).alias("decision"))


@book.add("r19_adoption_gate", f"{WITH}, m AS (SELECT avg(CASE WHEN (s >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN (s2 >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS b, count(*) AS n FROM scored) SELECT n >= 50 AS enough, b >= a - 0.05 AS not_worse, b > a AS better, n >= 50 AND b > a AS adopted FROM m")
def r19(spark, d):
    ok = lambda k: F.avg(((F.col(k) >= 0.5) == (F.col("y") == 1)).cast("double"))
    m = scored(spark, d).agg(ok("s").alias("a"), ok("s2").alias("b"), rows_count().alias("n"))
    a, b = F.col("a"), F.col("b")
    return m.select((F.col("n") >= 50).alias("enough"), (b >= a - 0.05).alias("not_worse"), (b > a).alias("better"), ((F.col("n") >= 50) & (b > a)).alias("adopted"))


@book.add("r22_relation_policy", f"{WITH}, s AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN y = 1 THEN 'abrupt' ELSE 'slow' END END AS shape FROM scored) SELECT doc_id, CASE WHEN lang = 'fr' THEN 'NO_BOUNDARY' WHEN shape IS NULL THEN 'UNRESOLVED' WHEN shape = 'abrupt' THEN 'BOUNDARY' ELSE 'SOFT' END AS policy, CASE WHEN shape IS NULL THEN 'inherited' ELSE 'observed' END AS origin FROM s")
def r22(spark, d):
    shape = F.when(F.col("doc_id") % 3 != 0, F.when(F.col("y") == 1, "abrupt").otherwise("slow"))
    policy = F.when(F.col("lang") == "fr", "NO_BOUNDARY").when(shape.isNull(), "UNRESOLVED").when(shape == "abrupt", "BOUNDARY").otherwise("SOFT")
    return scored(spark, d).select("doc_id", policy.alias("policy"), F.when(shape.isNull(), "inherited").otherwise("observed").alias("origin"))


@book.add("r23_timing_consistency", f"WITH {CURVE}, c AS (SELECT user_id, list_sort(list(i)) AS stated, list_sort(list(CASE WHEN i % 29 = 0 THEN i + 1 ELSE i END)) AS derived FROM curve WHERE label = 'purchase' GROUP BY user_id) SELECT user_id, len(list_filter(stated, lambda x: NOT list_contains(derived, x))) AS mismatches FROM c")
def r23(spark, d):
    i = F.col("i")
    c = curve(spark, d).where("label = 'purchase'").groupBy("user_id").agg(F.collect_list(i).alias("stated"), F.collect_list(F.when(i % 29 == 0, i + 1).otherwise(i)).alias("derived"))
    return c.select("user_id", F.size(F.array_except("stated", "derived")).cast("long").alias("mismatches"))


@book.add("b08_per_peak_shift", f"WITH {CURVE}, {TRUTH}, sp AS (SELECT user_id, min(t) AS lo, max(t) - min(t) AS span FROM curve GROUP BY 1), b AS (SELECT unnest(generate_series(0, 19)) AS b), mv AS (SELECT c.user_id, b, lo + fmod(t - lo + ((b * 104729 + i * 7919) % 100003) / 100003::DOUBLE * span, span) AS t FROM curve c JOIN sp USING (user_id), b WHERE label = 'click'), h AS (SELECT b.b, g.user_id, g.g, count(m.t) > 0 AS h FROM truth g CROSS JOIN b LEFT JOIN mv m ON m.user_id = g.user_id AND m.b = b.b AND abs(m.t - g.u) <= {TOL / 6} GROUP BY 1, 2, 3) SELECT b, count(*) FILTER (WHERE h) AS hits FROM h GROUP BY b")
def b08(spark, d):
    """A shift of its own for every peak, which is another null than one shift a recording."""
    clicks, times = curve(spark, d).where("label = 'click'").select("user_id", "t", "i"), curve(spark, d).select("user_id", "t")
    return shifts.own_shifts(clicks, truth(spark, d), shifts.spans_of(times), "user_id", "t", "i", "u", TOL / 6, 20).where("b >= 0").select("b", "hits")


@book.add("b12_detectable_auroc", f"{WITH}, n AS (SELECT b, y, {ORDER} AS r FROM scored, (SELECT unnest(generate_series(0, 49)) AS b) q), a AS ({auroc_sql('r', 'n')}) SELECT round(quantile_cont(a, 0.95), 6) AS p95 FROM a")
def b12(spark, d):
    """The 95th percentile of the AUROC of scores that know nothing, for the classes' sizes."""
    each = scored(spark, d).select("doc_id", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("b"))
    noise = each.withColumn("r", resample.shuffled("b", "doc_id").cast("double"))
    return metrics.auroc(noise, ["b"], "r", "y").agg(r6(F.percentile("auroc", 0.95)).alias("p95"))


@book.add("b13_shuffled_control", f"WITH {CURVE}, n AS (SELECT user_id, i, prob, row_number() OVER (PARTITION BY user_id ORDER BY t, i) AS k, row_number() OVER (PARTITION BY user_id ORDER BY i * 7919 % 1009, i) AS q FROM curve) SELECT a.user_id, round(sum(abs(a.prob - b.prob)), 2) AS control FROM n a JOIN n b ON a.user_id = b.user_id AND a.k = b.q GROUP BY a.user_id")
def b13(spark, d):
    w = W.partitionBy("user_id")
    n = curve(spark, d).select("user_id", "i", "prob", F.row_number().over(w.orderBy("t", "i")).alias("k"), F.row_number().over(w.orderBy(sampling.draw("i"), "i")).alias("q"))
    other = n.select("user_id", F.col("q").alias("k"), F.col("prob").alias("other"))
    return n.join(other, ["user_id", "k"]).groupBy("user_id").agg(F.round(F.sum(F.abs(F.col("prob") - F.col("other"))), 2).alias("control"))


@book.add("b14_random_topk_control", f"WITH {CURVE}, {TRUTH}, g AS (SELECT user_id, count(*) AS k FROM truth GROUP BY user_id), r AS (SELECT c.user_id, c.t, row_number() OVER (PARTITION BY c.user_id ORDER BY c.i * 7919 % 1009, c.i) AS q FROM curve c), p AS (SELECT r.user_id, r.t FROM r JOIN g ON r.user_id = g.user_id AND r.q <= g.k) SELECT count(*) AS n, count(*) FILTER (WHERE h) AS hits FROM (SELECT t.user_id, t.g, count(p.t) > 0 AS h FROM truth t LEFT JOIN p ON p.user_id = t.user_id AND abs(p.t - t.u) <= 3600 GROUP BY 1, 2) q")
def b14(spark, d):
    g = truth(spark, d)
    k = g.groupBy("user_id").agg(rows_count().alias("k"))
    r = curve(spark, d).withColumn("q", F.row_number().over(W.partitionBy("user_id").orderBy(sampling.draw("i"), "i")))
    p = r.join(k, "user_id").where("q <= k").select("user_id", "t")
    hit = intervals.tolerance_join(g, p, U, "u", "t", HOUR, "left").groupBy("user_id", "g").agg((F.count("t") > 0).alias("h"))
    return hit.agg(rows_count().alias("n"), F.count_if("h").alias("hits"))


@book.add("b15_label_flip_null", f"{WITH}, f AS (SELECT b, s2, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY {ORDER}, doc_id) <= 20 THEN 1 - y ELSE y END AS y FROM scored, (SELECT unnest(generate_series(0, 19)) AS b) q), a AS ({auroc_sql('s2', 'f')}) SELECT b, round(a, 6) AS auroc FROM a")
def b15(spark, d):
    """AUROC after as many random flips as were corrected, by replicate."""
    flipped = resample.first_rows(scored(spark, d).select("doc_id", "y", "s2"), "doc_id", 20, F.lit(20)).withColumn("y2", F.when(F.col("first"), 1 - F.col("y")).otherwise(F.col("y")))
    return metrics.auroc(flipped, ["b"], "s2", "y2").select("b", r6("auroc").alias("auroc"))


@book.add("m02_impute_scale", f"{WITH}, x AS (SELECT doc_id, doc_id % 5 AS fold, CASE WHEN doc_id % 17 <> 0 THEN s END AS v FROM scored), f AS (SELECT avg(v) AS m FROM x WHERE fold <> 0), g AS (SELECT stddev_pop(coalesce(v, m)) AS sd FROM x, f WHERE fold <> 0) SELECT doc_id, round((coalesce(v, m) - m) / (sd + 1e-8), 6) AS z FROM x, f, g WHERE fold = 0")
def m02(spark, d):
    x = scored(spark, d).select("doc_id", (F.col("doc_id") % 5).alias("fold"), F.when(F.col("doc_id") % 17 != 0, F.col("s")).alias("v"))
    train = x.where("fold <> 0")
    m = train.agg(F.avg("v").alias("m"))
    sd = train.join(F.broadcast(m)).agg(F.stddev_pop(F.coalesce("v", "m")).alias("sd"))
    return x.where("fold = 0").join(F.broadcast(m)).join(F.broadcast(sd)).select("doc_id", r6((F.coalesce("v", "m") - F.col("m")) / (F.col("sd") + 1e-8)).alias("z"))


@book.add("m07_fold_thresholds", f"{WITH}, e AS (SELECT f AS fold, doc_id % 5 = f AS held, s, y FROM scored, (SELECT unnest([0, 1, 2, 3, 4]) AS f) q), c AS (SELECT fold, s, sum(count(*)) OVER w AS n, sum(count(*) FILTER (WHERE y = 1)) OVER w AS tp FROM e WHERE NOT held AND s IS NOT NULL GROUP BY fold, s WINDOW w AS (PARTITION BY fold ORDER BY s DESC)), t AS (SELECT fold, min(s) AS tau FROM c WHERE n >= 10 AND tp / (n + 1) >= 0.78 GROUP BY fold) SELECT fold, count(*) FILTER (WHERE s >= tau) AS kept, count(*) FILTER (WHERE s >= tau AND y = 1) AS \"right\" FROM e LEFT JOIN t USING (fold) WHERE held GROUP BY fold")
def m07(spark, d):
    """Per fold the loosest threshold of the other folds that keeps a precision, and what it gives in the fold."""
    rows = scored(spark, d).withColumn("own", (F.col("doc_id") % 5).cast("int"))
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    curve_ = metrics.cumulative(each.where("fold <> own"), ["fold"], "s", "y").where((F.col("n") >= 10) & (F.col("tp") / (F.col("n") + 1) >= 0.78))
    tau = curve_.groupBy("fold").agg(F.min("s").alias("tau"))
    held = each.where("fold = own").join(tau, "fold", "left")
    keep = F.coalesce(F.col("s") >= F.col("tau"), F.lit(False))
    return held.groupBy("fold").agg(F.count_if(keep).alias("kept"), F.count_if(keep & (F.col("y") == 1)).alias("right"))


@book.add("u08_similar_label_groups")
def u08(spark, d):
    """Items whose word sets overlap by 0.15 or more, joined into groups.

    Two sets at a Jaccard of t share a word among all but ceil(t n) - 1 of the rarest
    of each one's n words; no pair is missed. Sets without words equal each other.
    """
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("w"))
    words = t.select("item_id", F.size("w").alias("n"), F.explode(F.when(F.size("w") > 0, F.col("w")).otherwise(F.array(F.lit("")))).alias("word"))
    ranked = words.join(words.groupBy("word").agg(rows_count().alias("df")), "word").withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy("df", "word")))
    keyed = ranked.where(F.col("rank") <= F.col("n") - F.ceil(0.15 * F.col("n") - 1e-9) + 1)
    pairs = keyed.select("word", F.col("item_id").alias("a"), F.col("n").alias("na")).join(keyed.select("word", F.col("item_id").alias("b"), F.col("n").alias("nb")), "word").where("a < b AND na >= 0.15 * nb - 1e-9 AND nb >= 0.15 * na - 1e-9").select("a", "b").distinct()
    both = pairs.join(t.select(F.col("item_id").alias("a"), F.col("w").alias("wa")), "a").join(t.select(F.col("item_id").alias("b"), F.col("w").alias("wb")), "b")
    edges = both.where(tx.jaccard(F.col("wa"), F.col("wb")) >= 0.15).select("a", "b").distinct()
    return graph.linked_groups(t, edges, "item_id")


@book.add("g08_smart_resize", "WITH x AS (SELECT p_partkey, p_size * 31 + 100 AS h, p_size * 17 + 200 AS w FROM part) SELECT p_partkey, CAST(CASE WHEN round_even(h / 28.0, 0) * 28 * round_even(w / 28.0, 0) * 28 > 600000 THEN greatest(floor(h / sqrt(h * w / 600000.0) / 28) * 28, 28) ELSE round_even(h / 28.0, 0) * 28 END AS BIGINT) AS height, CAST(CASE WHEN round_even(h / 28.0, 0) * 28 * round_even(w / 28.0, 0) * 28 > 600000 THEN greatest(floor(w / sqrt(h * w / 600000.0) / 28) * 28, 28) ELSE round_even(w / 28.0, 0) * 28 END AS BIGINT) AS width FROM x")
def g08(spark, d):
    h, w = F.col("p_size") * 31 + 100, F.col("p_size") * 17 + 200
    height, width = sc.smart_resize(h, w, 28, 600000)
    return table(spark, d, "part").select("p_partkey", height.alias("height"), width.alias("width"))


@book.add("f14_reorder_arms", f"{TIME}, a AS (SELECT user_id, seg, label, lead(label) OVER (PARTITION BY user_id ORDER BY s, e) AS n FROM segments) SELECT user_id, seg, label || ' then ' || n AS original, n || ' then ' || label AS reordered FROM a WHERE n IS NOT NULL AND n <> label")
def f14(spark, d):
    a = segments(spark, d).withColumn("n", F.lead("label").over(W.partitionBy("user_id").orderBy("s", "e"))).where("n IS NOT NULL AND n <> label")
    return a.select("user_id", "seg", F.concat("label", F.lit(" then "), "n").alias("original"), F.concat("n", F.lit(" then "), "label").alias("reordered"))


@book.add("v02_peak_counts", f"WITH {PEAKS} SELECT user_id, count(*) AS n FROM peaks GROUP BY user_id")
def v02_counts(spark, d):
    return peaks(spark, d).groupBy("user_id").agg(rows_count().alias("n"))
