"""Queries on audits: error taxonomies, policies and gates as their configurations state them, matching, nested validation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import intervals, matching, models, rules, sampling, tracks
from ..operators.ordering import numbered
from .base import CURVE, HOUR, SCORED, SEGMENTS, TOL, TRUTH, Book, curve, r6, scored, segments, truth
from .modelling import boxes
from .temporal import PEAKS, U, decoded, peaks

book = Book()
WITH = f"WITH {SCORED}"


def rows_count():
    return F.count(F.lit(1))


HELD = "held AS (SELECT * FROM segments WHERE label IN ('view', 'click'))"
FATES = f"""WITH {PEAKS}, segments AS (SELECT user_id, seg, label, t AS s, e FROM (SELECT *, lead(t) OVER w AS e, CAST(row_number() OVER w AS BIGINT) AS seg FROM curve WINDOW w AS (PARTITION BY user_id ORDER BY t, i)) q WHERE e IS NOT NULL), {TRUTH}, {HELD},
kept AS (SELECT user_id, k.i AS i, k.t AS t FROM (SELECT user_id, unnest(kept) AS k FROM folded) x),
pairs AS (SELECT g.user_id, g.g, k.i, k.t - g.u AS o, row_number() OVER (PARTITION BY g.user_id, g.g ORDER BY abs(k.t - g.u), k.t) AS r FROM truth g JOIN kept k ON k.user_id = g.user_id AND abs(k.t - g.u) <= {TOL}),
best AS (SELECT g.user_id, g.g, max(c.prob) AS p FROM truth g LEFT JOIN curve c ON c.user_id = g.user_id AND abs(c.t - g.u) <= {TOL} GROUP BY 1, 2), med AS (SELECT user_id, quantile_cont(prob, 0.5) AS m FROM curve GROUP BY 1),
loc AS (SELECT g.user_id, g.g, arg_min({{'i': p.i, 'prob': p.prob}}, {{'d': abs(p.t - g.u), 't': p.t, 'i': p.i}}) AS x FROM truth g JOIN peaks p ON p.user_id = g.user_id AND abs(p.t - g.u) <= {TOL} GROUP BY 1, 2),
gs AS (SELECT t.user_id, t.g AS id, CASE WHEN abs(a.o) <= {HOUR} THEN 'exact' WHEN a.o < 0 THEN 'early' WHEN a.o >= 0 THEN 'late' WHEN b.p < m.m THEN 'weak_signal' WHEN l.x IS NULL THEN 'not_a_local_maximum' WHEN l.x.prob < 35 THEN 'below_threshold' WHEN k.i IS NULL THEN 'suppressed_by_min_gap' ELSE 'kept_outside_tolerance' END AS status
FROM truth t LEFT JOIN pairs a ON a.user_id = t.user_id AND a.g = t.g AND a.r = 1 JOIN best b ON b.user_id = t.user_id AND b.g = t.g JOIN med m ON m.user_id = t.user_id LEFT JOIN loc l ON l.user_id = t.user_id AND l.g = t.g LEFT JOIN kept k ON k.user_id = t.user_id AND k.i = l.x.i),
inside AS (SELECT k.user_id, k.i, arg_min((k.t - s.s) / greatest(s.e - s.s, 1e-6), {{'s': s.s, 'e': s.e}}) AS frac FROM kept k LEFT JOIN held s ON s.user_id = k.user_id AND k.t >= s.s AND k.t <= s.e GROUP BY 1, 2),
ks AS (SELECT k.user_id, k.i AS id, CASE WHEN p.i IS NOT NULL THEN 'duplicate' WHEN n.frac IS NULL THEN 'false_gap' WHEN n.frac < 0.15 OR n.frac > 0.85 THEN 'false_near_edge' ELSE 'false_mid_segment' END AS status FROM kept k JOIN inside n USING (user_id, i) LEFT JOIN (SELECT DISTINCT user_id, i FROM pairs WHERE r > 1) p USING (user_id, i) WHERE NOT EXISTS (SELECT 1 FROM pairs u WHERE u.user_id = k.user_id AND u.i = k.i AND u.r = 1))"""


@book.add("v05_all_statuses", f"{FATES} SELECT user_id, 'truth' AS side, id, status FROM gs UNION ALL SELECT user_id, 'peak', id, status FROM ks")
def v05(spark, d):
    """All twelve: what became of each true boundary, and of each decoded peak that explains none."""
    g, kept, c = truth(spark, d), decoded(spark, d).select("user_id", "i", "t"), curve(spark, d)
    o = F.col("t") - F.col("u")
    pairs = intervals.tolerance_join(g, kept, U, "u", "t", TOL).withColumn("o", o).withColumn("r", F.row_number().over(W.partitionBy("user_id", "g").orderBy(F.abs(o), "t"))).select("user_id", "g", "i", "o", "r")
    best = intervals.best_within(g, c.select("user_id", "t", "prob"), U, "u", "t", TOL, "prob", ["g"]).select("user_id", "g", "best_score")
    median = c.groupBy("user_id").agg(F.percentile("prob", 0.5).alias("m"))
    near = intervals.tolerance_join(g, peaks(spark, d).select("user_id", "i", "t", "prob"), U, "u", "t", TOL).groupBy("user_id", "g").agg(F.min_by(F.struct("i", "prob"), F.struct(F.abs(o), "t", "i")).alias("x"))
    survivors = kept.select(F.col("user_id").alias("of"), F.col("i").alias("survivor"))
    told = g.join(pairs.where("r = 1").select("user_id", "g", "o"), ["user_id", "g"], "left").join(best, ["user_id", "g"]).join(median, "user_id").join(near, ["user_id", "g"], "left")
    told = told.join(survivors, (F.col("user_id") == F.col("of")) & (F.col("x.i") == F.col("survivor")), "left")
    x = F.col("o")
    of_truth = rules.first_reason([("exact", F.abs(x) <= HOUR), ("early", x < 0), ("late", x >= 0), ("weak_signal", F.col("best_score") < F.col("m")), ("not_a_local_maximum", F.col("x").isNull()), ("below_threshold", F.col("x.prob") < 35), ("suppressed_by_min_gap", F.col("survivor").isNull())])
    seen = pairs.groupBy("user_id", "i").agg(F.min("r").alias("first"))
    held = segments(spark, d).where("label IN ('view', 'click')")
    inside = intervals.containing(kept, held, U, "t", "s", "e", ["i"], ["s", "e"], 12 * HOUR)
    part = (F.col("t") - F.col("s")) / F.greatest(F.col("e") - F.col("s"), F.lit(1e-6))
    rest = inside.join(seen, ["user_id", "i"], "left").where("first IS NULL OR first > 1")
    of_peak = rules.first_reason([("duplicate", F.col("first").isNotNull()), ("false_gap", F.col("s").isNull()), ("false_near_edge", (part < 0.15) | (part > 0.85))])
    a = told.select("user_id", F.lit("truth").alias("side"), F.col("g").alias("id"), F.coalesce(of_truth, F.lit("kept_outside_tolerance")).alias("status"))
    return a.unionByName(rest.select("user_id", F.lit("peak").alias("side"), F.col("i").alias("id"), F.coalesce(of_peak, F.lit("false_mid_segment")).alias("status")))


WINDOWS = {"a": (-6, 0), "b": (0, 6), "c": (-24, 0), "d": (0, 24), "f": (24, 48), "vl": (-12, 0), "vr": (0, 12)}
MEANS = ", ".join(f"avg(x) FILTER (WHERE o >= {lo * 3600} AND o < {hi * 3600}) AS {k}" + (f", var_pop(x) FILTER (WHERE o >= {lo * 3600} AND o < {hi * 3600}) AS v{k}, count(x) FILTER (WHERE o >= {lo * 3600} AND o < {hi * 3600}) AS n{k}" if k[0] == "v" else "") for k, (lo, hi) in WINDOWS.items())


def cosine_sql(p, q):
    return f"CASE WHEN sum({p} * {p}) > 0 AND sum({q} * {q}) > 0 THEN round(1 - sum({p} * {q}) / sqrt(sum({p} * {p}) * sum({q} * {q})), 6) END"


@book.add("w01_all_features", f"WITH {CURVE}, {TRUTH}, x AS (SELECT g.user_id, g.g, c.t - g.u AS o, unnest([{{'k': 0, 'x': c.prob}}, {{'k': 1, 'x': c.prob * c.prob / 50}}, {{'k': 2, 'x': CAST(c.i % 7 AS DOUBLE)}}]) AS v FROM truth g JOIN curve c ON c.user_id = g.user_id AND c.t >= g.u - 86400 AND c.t < g.u + 172800), m AS (SELECT user_id, g, v.k AS k, {MEANS.replace('(x)', '(v.x)')} FROM x GROUP BY 1, 2, 3) SELECT user_id, g, {cosine_sql('a', 'b')} AS short_change, {cosine_sql('c', 'd')} AS context_change, {cosine_sql('c', 'f')} AS change_persistence, round(avg(CASE WHEN nvl >= 2 THEN vvl END), 6) AS left_variance, round(avg(CASE WHEN nvr >= 2 THEN vvr END), 6) AS right_variance FROM m GROUP BY 1, 2")
def w01(spark, d):
    """All five: cosine distances of windows' means next to, around and after a boundary, and the variance within each side."""
    c = curve(spark, d).select("user_id", "t", F.array(F.col("prob"), F.col("prob") * F.col("prob") / 50, (F.col("i") % 7).cast("double")).alias("v"))
    near = intervals.tolerance_join(truth(spark, d), c, U, "u", "t", 48 * HOUR).withColumn("o", F.col("t") - F.col("u")).where(f"o >= {-24 * HOUR}")
    x, o = F.col("x"), F.col("o")
    each = near.select("user_id", "g", "o", F.posexplode("v").alias("k", "x"))
    inside = {k: F.when((o >= lo * HOUR) & (o < hi * HOUR), x) for k, (lo, hi) in WINDOWS.items()}
    m = each.groupBy("user_id", "g", "k").agg(*[F.avg(w).alias(k) for k, w in inside.items()], *[f(inside[k]).alias(n + k) for k in ("vl", "vr") for f, n in ((F.var_pop, "v"), (F.count, "n"))])

    def far(p, q):
        p, q = F.col(p), F.col(q)
        return F.when((F.sum(p * p) > 0) & (F.sum(q * q) > 0), r6(1 - F.sum(p * q) / F.sqrt(F.sum(p * p) * F.sum(q * q))))

    return m.groupBy("user_id", "g").agg(far("a", "b").alias("short_change"), far("c", "d").alias("context_change"), far("c", "f").alias("change_persistence"), r6(F.avg(F.when(F.col("nvl") >= 2, F.col("vvl")))).alias("left_variance"), r6(F.avg(F.when(F.col("nvr") >= 2, F.col("vvr")))).alias("right_variance"))


@book.add("j18_minimum_cost_links", """WITH b AS (SELECT l_suppkey AS rec, epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 86400e6 AS t, l_orderkey * 8 + l_linenumber AS id, l_returnflag AS label, l_quantity AS x0, l_quantity / 2 AS y0, l_quantity + 30 AS x1, l_quantity / 2 + 30 AS y1 FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY rec, t ORDER BY id) AS k, dense_rank() OVER (PARTITION BY rec ORDER BY t) AS f FROM b), two AS (SELECT * FROM r WHERE k <= 2),
c AS (SELECT p.rec, p.f, p.id AS a, q.id AS z, p.k AS pk, q.k AS qk, sqrt(pow((p.x0 + p.x1 - q.x0 - q.x1) / 2, 2) + pow((p.y0 + p.y1 - q.y0 - q.y1) / 2, 2)) / ((sqrt(pow(p.x1 - p.x0, 2) + pow(p.y1 - p.y0, 2)) + sqrt(pow(q.x1 - q.x0, 2) + pow(q.y1 - q.y0, 2))) / 2) - greatest(least(p.x1, q.x1) - greatest(p.x0, q.x0), 0) * greatest(least(p.y1, q.y1) - greatest(p.y0, q.y0), 0) / ((p.x1 - p.x0) * (p.y1 - p.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - greatest(least(p.x1, q.x1) - greatest(p.x0, q.x0), 0) * greatest(least(p.y1, q.y1) - greatest(p.y0, q.y0), 0)) + CASE WHEN p.label <> q.label THEN 0.5 ELSE 0 END AS cost FROM two p JOIN two q ON p.rec = q.rec AND q.f = p.f + 1),
n AS (SELECT *, max(pk) OVER w AS np, max(qk) OVER w AS nq, round(sum(CASE WHEN pk = qk THEN cost END) OVER w, 9) AS straight, round(sum(CASE WHEN pk <> qk THEN cost END) OVER w, 9) AS crossed, row_number() OVER (PARTITION BY rec, f ORDER BY round(cost, 9), pk, qk) AS best FROM c WINDOW w AS (PARTITION BY rec, f))
SELECT rec, a, z, round(cost, 6) AS cost FROM n WHERE cost <= 3 AND CASE WHEN np = 2 AND nq = 2 THEN (pk = qk) = (straight <= crossed) ELSE best = 1 END""")
def j18(spark, d):
    """Links between at most two boxes of a frame and those of the next, at the least total cost; a costly one starts a track anew."""
    return tracks.least_cost_links(boxes(spark, d), "rec", "t", 3.0).select("rec", "a", "z", r6("cost").alias("cost"))


@book.add("j21_nearest_without_replacement")
def j21(spark, d):
    """False keeps of each source, in order of id, with the true keep of the nearest score that is still free."""
    rows = scored(spark, d).where("s >= 0.4 AND lang = 'en' AND y IN (0, 1)").withColumn("chooses", F.col("y") == 0)
    return matching.nearest_free(rows, "source", "doc_id", "s2", "chooses").select("source", "left", "right", r6("gap").alias("gap"))


@book.add("j24_segment_recovery", f"WITH {SEGMENTS}, claims AS (SELECT user_id, i, t, label AS said, i % 5 = 0 AS shown FROM curve WHERE i % 2 = 0), spot AS (SELECT c.user_id, c.i, arg_min(s.label, {{'s': -s.s, 'e': s.e}}) AS found FROM claims c LEFT JOIN segments s ON s.user_id = c.user_id AND c.t >= s.s AND c.t <= s.e AND s.label <> 'error' GROUP BY 1, 2) SELECT user_id, i, found, CASE WHEN found IS NULL THEN 'no_segment' WHEN contains(found, left(said, 4)) THEN 'verified' ELSE 'label_mismatch' END AS status, shown AS shown_in_sheet FROM claims JOIN spot USING (user_id, i)")
def j24(spark, d):
    """Claims at a time get the segment they lie in, whose label must hold what they say."""
    claims = curve(spark, d).where("i % 2 = 0").select("user_id", "i", "t", F.col("label").alias("said"), (F.col("i") % 5 == 0).alias("shown_in_sheet"))
    held = segments(spark, d).where("label <> 'error'").select("user_id", "s", "e", F.col("label").alias("found"))
    hits = intervals.containing_all(claims.select("user_id", "i", "t"), held, U, "t", "s", "e", 12 * HOUR)
    best = hits.groupBy("user_id", "i").agg(F.min_by("found", F.struct(-F.col("s"), "e")).alias("found"))
    status = F.when(F.col("found").isNull(), "no_segment").when(F.col("found").contains(F.substring("said", 1, 4)), "verified").otherwise("label_mismatch")
    return claims.join(best, ["user_id", "i"], "left").select("user_id", "i", "found", status.alias("status"), "shown_in_sheet")


@book.add("v25_two_track_features", """WITH b AS (SELECT l_suppkey AS rec, epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 86400e6 AS t, l_orderkey * 8 + l_linenumber AS id, l_quantity + 15 AS cx, l_quantity / 2 + 15 AS cy FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY rec, t ORDER BY id) AS k FROM b),
f AS (SELECT rec, t, CASE WHEN max(k) >= 2 THEN sqrt(pow(max(CASE WHEN k = 1 THEN cx END) - max(CASE WHEN k = 2 THEN cx END), 2) + pow(max(CASE WHEN k = 1 THEN cy END) - max(CASE WHEN k = 2 THEN cy END), 2)) / sqrt(1800) END AS d FROM r GROUP BY rec, t),
w AS (SELECT *, avg(d) OVER (PARTITION BY rec) AS m, count(d) OVER (PARTITION BY rec) AS n FROM f), s AS (SELECT rec, t, d, n, (d IS NOT NULL) <> lag(d IS NOT NULL) OVER o AS flip, coalesce(d, m) - lag(coalesce(d, m)) OVER o AS dd FROM w WINDOW o AS (PARTITION BY rec ORDER BY t))
SELECT rec, count(*) FILTER (WHERE flip) AS presence_changes, round(abs(quantile_cont(CASE WHEN t >= 9500 THEN d END, 0.5) - quantile_cont(CASE WHEN t < 9500 THEN d END, 0.5)), 6) AS distance_change, CASE WHEN max(n) >= 6 AND avg(abs(dd)) > 0 THEN round(1 - stddev_pop(dd) / (avg(abs(dd)) + 1e-9), 6) END AS synchrony FROM s GROUP BY rec""")
def v25(spark, d):
    """Distance of two tracks in their boxes' diagonals: its change across a time, how even its steps are, how often one track is missing."""
    return tracks.two_track_features(boxes(spark, d), "rec", "t", 9500.0).select("rec", "presence_changes", r6("distance_change").alias("distance_change"), r6("synchrony").alias("synchrony"))


@book.add("p17_feature_ablation", "SELECT vec_id, round(sqrt(list_sum(list_transform(list_concat(list_slice(embedding, 1, 16), list_slice(embedding, 33, 64)), lambda x: CAST(x AS DOUBLE) * x))), 5) AS kept_norm, 48 AS kept FROM embeddings WHERE embedding IS NOT NULL")
def p17(spark, d):
    """Vectors without the block of a feature group that is a shortcut."""
    from ..functions import vectors as vx
    from ..session import table

    blocks = {"appearance": (0, 16), "duration": (16, 32), "motion": (32, 64)}
    kept = vx.without_blocks(F.col("embedding"), blocks, ["duration"])
    return table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.round(F.sqrt(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 5).alias("kept_norm"), F.size(kept).alias("kept"))


@book.add("m03_leave_one_recording_out")
def m03(spark, d):
    """Each source scored by a model fitted on all others; with sources that are skipped counted as null."""
    rows = scored(spark, d)
    number = numbered(rows.select("source").distinct(), F.col("source").asc_nulls_first()).select("source", F.col("place").cast("int").alias("fold"))  # one row a recording
    n = number.count()
    f = rows.join(number, rows["source"].eqNullSafe(number["source"])).select("doc_id", "fold", "y", "s", "s2", F.col("z").cast("double").alias("zz"))
    oof = models.out_of_fold(f, "fold", "doc_id", ["s", "s2", "zz"], "y", n, least=6)
    return oof.select("doc_id", "fold", F.round("score", 4).alias("score"))


@book.add("m10b_nested_threshold")
def m10b(spark, d):
    rows = scored(spark, d)
    folds = sampling.grouped_folds(rows, "source", 4)
    f = rows.join(folds, "source").withColumn("inner", F.pmod(F.xxhash64("source", F.lit(1)), F.lit(3)).cast("int"))
    return models.nested(f, "fold", "inner", "doc_id", ["s", "s2"], "y", 4, 3, 0.7).select("fold", "n", F.round("threshold", 4).alias("threshold"), "kept", "right", (F.col("kept") == 0).alias("automates_nothing"))


MODES = "p AS (SELECT doc_id, s AS a, s2 AS b, 1 - s AS c, y, z FROM scored), t AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 'POINT' WHEN b >= c THEN 'INTERVAL' ELSE 'UNOBSERVABLE' END AS top FROM p)"


@book.add("r12_veto_modes", f"{WITH}, {MODES}, m AS (SELECT unnest(['full', 'morphology_only', 'none']) AS mode) SELECT doc_id, mode, CASE WHEN mode = 'none' THEN NULL WHEN mode = 'morphology_only' THEN CASE WHEN top <> 'POINT' THEN top || ' is never automatic' END WHEN top <> 'POINT' THEN top || ' is never automatic' WHEN z = 1 THEN 'observability' WHEN y = 0 THEN 'relation' END AS reason FROM t, m")
def r12(spark, d):
    p = F.create_map(F.lit("POINT"), F.col("s"), F.lit("INTERVAL"), F.col("s2"), F.lit("UNOBSERVABLE"), 1 - F.col("s"))
    rows = scored(spark, d).withColumn("top", rules.argmax(p, ["POINT", "INTERVAL", "UNOBSERVABLE"])).withColumn("mode", F.explode(F.array(F.lit("full"), F.lit("morphology_only"), F.lit("none"))))
    full = [("observability", F.col("z") == 1), ("relation", F.col("y") == 0)]
    return rows.select("doc_id", "mode", rules.structural_veto(F.col("mode"), F.col("top"), ["INTERVAL", "UNOBSERVABLE"], full).alias("reason"))


ACTIONS = {
    "AUTO_KEEP": {"morphology": ["POINT"], "relation": ["EXACT"], "min_confidence": 0.5, "max_offset": 0.6, "forbid": ["es"]},
    "SUGGEST_RETIME": {"morphology": ["POINT"], "relation": ["EARLY", "LATE"], "min_confidence": 0.4, "max_offset": 1.0, "enabled": False},
    "AUTO_REJECT": {"morphology": ["NONE"], "relation": ["EXACT", "EARLY", "LATE"], "min_confidence": 0.3},
}
# the same actions in SQL, one condition each
FITS = {
    "AUTO_KEEP": "m = 'POINT' AND r = 'EXACT' AND pm >= 0.5 AND pr >= 0.5 AND abs(off) <= 0.6 AND lang IS DISTINCT FROM 'es'",
    "SUGGEST_RETIME": "m = 'POINT' AND r IN ('EARLY', 'LATE') AND pm >= 0.4 AND pr >= 0.4 AND abs(off) <= 1.0",
    "AUTO_REJECT": "m = 'NONE' AND pm >= 0.3 AND pr >= 0.3",
}


@book.add("r13_policy_actions", f"{WITH}, q AS (SELECT doc_id, lang, s - s2 AS off, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN z = 1 THEN 'poor' ELSE 'clear' END AS view, CASE WHEN s >= s2 AND s >= 0.45 THEN 'POINT' WHEN s2 >= 0.45 THEN 'NONE' ELSE 'GRADUAL' END AS m, greatest(s, s2, 0.45) AS pm, CASE WHEN y = 1 THEN 'EXACT' WHEN doc_id % 2 = 0 THEN 'EARLY' ELSE 'LATE' END AS r, CASE WHEN y = 1 THEN 0.8 WHEN doc_id % 2 = 0 THEN 0.45 ELSE 0.35 END AS pr FROM scored) SELECT doc_id, CASE WHEN m = 'GRADUAL' OR view IS NULL OR view <> 'clear' THEN 'REVIEW' WHEN {FITS['AUTO_KEEP']} THEN 'AUTO_KEEP' WHEN {FITS['SUGGEST_RETIME']} THEN 'REVIEW' WHEN {FITS['AUTO_REJECT']} THEN 'AUTO_REJECT' ELSE 'REVIEW' END AS action, CASE WHEN NOT (m = 'GRADUAL' OR view IS NULL OR view <> 'clear') AND NOT ({FITS['AUTO_KEEP']}) AND {FITS['SUGGEST_RETIME']} THEN 'SUGGEST_RETIME' END AS blocked_action, CASE WHEN m = 'GRADUAL' THEN 'never_automatic' WHEN view IS NULL THEN 'view_missing' WHEN view <> 'clear' THEN 'view_blocks' END AS blocked_by FROM q")
def r13(spark, d):
    s, s2, y = F.col("s"), F.col("s2"), F.col("y")
    even = F.col("doc_id") % 2 == 0
    q = scored(spark, d).select("doc_id", F.col("lang").alias("subtype"), (s - s2).alias("offset"), F.when(F.col("doc_id") % 17 != 0, F.when(F.col("z") == 1, "poor").otherwise("clear")).alias("view"), F.create_map(F.lit("POINT"), s, F.lit("NONE"), s2, F.lit("GRADUAL"), F.lit(0.45)).alias("morphology"), F.create_map(F.lit("EXACT"), F.when(y == 1, 0.8).otherwise(0.1), F.lit("EARLY"), F.when((y != 1) & even, 0.45).otherwise(0.05), F.lit("LATE"), F.when((y != 1) & ~even, 0.35).otherwise(0.05)).alias("relation"))
    orders = {"morphology": ["POINT", "NONE", "GRADUAL"], "relation": ["EXACT", "EARLY", "LATE"]}
    out = rules.ontology_action(orders, ["GRADUAL"], {"view": ["clear"]}, ACTIONS)
    return q.select("doc_id", out["action"].alias("action"), out["blocked_action"].alias("blocked_action"), out["blocked_by"].alias("blocked_by"))


@book.add("r14_joint_rules", f"{WITH}, q AS (SELECT doc_id, CASE WHEN z = 1 THEN 'OBSERVED_PRESENT' WHEN doc_id % 5 = 0 THEN 'NOT_OBSERVABLE' ELSE 'OBSERVED_ABSENT' END AS reset, CASE WHEN y = 1 THEN 'NO_TRANSITION' ELSE 'POINT' END AS morph, s AS mc, CASE WHEN doc_id % 3 = 0 THEN 'broken' ELSE 'continuous' END AS cont, CASE WHEN lang = 'es' THEN 'poor' ELSE 'clear' END AS view, s2 * 10 AS near, s AS lr, s2 AS rl, doc_id % 4 = 0 AS same, doc_id % 7 = 0 AS turn FROM scored), b AS (SELECT *, list_filter([CASE WHEN turn THEN 'direction_change_is_not_boundary' END, CASE WHEN reset = 'NOT_OBSERVABLE' THEN 'unseen_reset_is_not_absent_reset' END, CASE WHEN view <> 'clear' THEN 'unobservable_is_not_no_boundary' END, CASE WHEN same AND NOT (lr >= 0.3 AND rl >= 0.3) THEN 'same_label_is_not_same_instance' END], lambda x: x IS NOT NULL) AS blocks FROM q) SELECT doc_id, CASE WHEN reset = 'OBSERVED_PRESENT' THEN 'KEEP_BOUNDARY' WHEN morph = 'NO_TRANSITION' AND mc >= 0.4 AND cont = 'continuous' AND reset = 'OBSERVED_ABSENT' AND view = 'clear' AND near >= 1 AND lr >= 0.3 AND rl >= 0.3 AND len(blocks) = 0 THEN 'AUTO_REJECT_CANDIDATE' ELSE 'REVIEW' END AS action, CASE WHEN reset = 'OBSERVED_PRESENT' THEN [] ELSE blocks END AS blocked_by FROM b")
def r14(spark, d):
    c = F.col
    q = scored(spark, d).select("doc_id", F.when(c("z") == 1, "OBSERVED_PRESENT").when(c("doc_id") % 5 == 0, "NOT_OBSERVABLE").otherwise("OBSERVED_ABSENT").alias("reset"), F.when(c("y") == 1, "NO_TRANSITION").otherwise("POINT").alias("morphology"), c("s").alias("confidence"), F.when(c("doc_id") % 3 == 0, "broken").otherwise("continuous").alias("continuity"), F.when(c("lang") == "es", "poor").otherwise("clear").alias("view"), (c("s2") * 10).alias("nearby"), c("s").alias("left_supports_right"), c("s2").alias("right_supports_left"), (c("doc_id") % 4 == 0).alias("same_label"), (c("doc_id") % 7 == 0).alias("only_turned"))
    action, blocked = rules.joint_action({"strong": 0.4, "nearby": 1.0, "support": 0.3}, ["clear"])
    return q.select("doc_id", action.alias("action"), blocked.alias("blocked_by"))


@book.add("r19_adoption_checks", f"{WITH}, h AS (SELECT *, (s2 >= 0.5) = (y = 1) AS c, (s >= 0.5) = (y = 1) AS b FROM scored), f AS (SELECT doc_id % 5 AS fold, avg(CASE WHEN c THEN 1.0 ELSE 0 END) - avg(CASE WHEN b THEN 1.0 ELSE 0 END) AS delta FROM h GROUP BY 1), m AS (SELECT count(*) FILTER (WHERE c AND NOT b) - count(*) FILTER (WHERE b AND NOT c) AS net, count(*) FILTER (WHERE b AND NOT c AND y = 1) AS harms, avg(CASE WHEN c THEN 1.0 ELSE 0 END) - avg(CASE WHEN b THEN 1.0 ELSE 0 END) AS gain, avg(CASE WHEN s2 >= 0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE z = 1) AS fp, avg(CASE WHEN s >= 0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE z = 1) AS fpb, count(*) AS n, stddev_pop(CAST(c AS INT) - CAST(b AS INT)) AS sd FROM h), k AS (SELECT *, (SELECT min(delta) FROM f) AS worst FROM m), x AS (SELECT net >= 1 AS a1, harms <= 40 AS a2, gain >= 0.01 AS a3, worst >= -0.05 AS a4, fp <= 0.074 AS a5, fp <= fpb + 1e-9 AS a6, gain - 1.96 * sd / sqrt(n) > 0 AS a7 FROM k) SELECT a1 AS net_rescues, a2 AS harms, a3 AS gain, a4 AS worst_fold, a5 AS fp_absolute, a6 AS fp_relative, a7 AS interval_above_zero, a1 AND a2 AND a3 AND a4 AND a5 AND a7 AS strict, a1 AND a2 AND a3 AND a4 AND a6 AND a7 AS relative FROM x")
def r19(spark, d):
    y, z = F.col("y") == 1, F.col("z") == 1
    h = scored(spark, d).withColumns({"c": (F.col("s2") >= 0.5) == y, "b": (F.col("s") >= 0.5) == y})
    num = lambda x: x.cast("double")
    c, b = F.col("c"), F.col("b")
    worst = h.groupBy(F.col("doc_id") % 5).agg((F.avg(num(c)) - F.avg(num(b))).alias("delta")).agg(F.min("delta").alias("worst"))
    m = h.agg((F.count_if(c & ~b) - F.count_if(b & ~c)).alias("net"), F.count_if(b & ~c & y).alias("harms"), (F.avg(num(c)) - F.avg(num(b))).alias("gain"), F.avg(F.when(z, num(F.col("s2") >= 0.5))).alias("fp"), F.avg(F.when(z, num(F.col("s") >= 0.5))).alias("fp_base"), rows_count().alias("n"), F.stddev_pop(num(c) - num(b)).alias("sd"))
    limits = {"net": 1, "harms": 40, "gain": 0.01, "worst": 0.05, "fp": 0.074}
    return m.join(worst).select(*rules.adoption_checks(limits, F.col("gain") - 1.96 * F.col("sd") / F.sqrt("n")))


@book.add("r23_sheet_times", f"WITH {CURVE}, e AS (SELECT user_id, i, t, i % 3 AS k, CASE WHEN i % 11 = 0 THEN 'motion_phase_only' WHEN i % 13 = 0 THEN 'no_task_boundary' ELSE 'task_boundary' END AS status FROM curve WHERE label = 'purchase'), p AS (SELECT user_id, count(*) FILTER (WHERE status = 'task_boundary') AS boundaries, count(*) FILTER (WHERE status = 'motion_phase_only') AS phase_only, count(*) FILTER (WHERE status = 'no_task_boundary') AS no_change, list_sort(list(round(CASE WHEN k = 0 THEN (t + t + 60) / 2 ELSE t END, 2)) FILTER (WHERE status = 'task_boundary')) AS mine, list_sort(list(round(CASE WHEN k = 0 THEN t + 30 WHEN i % 29 = 0 THEN t + 1 ELSE t END, 2)) FILTER (WHERE status = 'task_boundary')) AS sheet FROM e GROUP BY user_id) SELECT user_id, boundaries, phase_only, no_change, coalesce(mine, []) = coalesce(sheet, []) AS agrees FROM p")
def r23(spark, d):
    """A sheet's canonical times against points and interval middles derived from its other cells; what asserts that there is no boundary."""
    i, t = F.col("i"), F.col("t")
    status = rules.first_reason([("motion_phase_only", i % 11 == 0), ("no_task_boundary", i % 13 == 0)])
    e = curve(spark, d).where("label = 'purchase'").withColumn("status", F.coalesce(status, F.lit("task_boundary")))
    derived = F.round(F.when(i % 3 == 0, (t + t + 60) / 2).otherwise(t), 2)
    stated = F.round(F.when(i % 3 == 0, t + 30).when(i % 29 == 0, t + 1).otherwise(t), 2)
    task = e.where("status = 'task_boundary'")
    # the two multisets differ where some time is stated more or less often than it is derived
    each = task.select("user_id", derived.alias("x"), F.lit(1).alias("n")).unionByName(task.select("user_id", stated.alias("x"), F.lit(-1).alias("n")))
    off = each.groupBy("user_id", "x").agg(F.sum("n").alias("n")).where("n <> 0").select("user_id").distinct().withColumn("off", F.lit(True))
    n = e.groupBy("user_id").agg(*[F.count_if(F.col("status") == k).alias(v) for k, v in (("task_boundary", "boundaries"), ("motion_phase_only", "phase_only"), ("no_task_boundary", "no_change"))])
    return n.join(off, "user_id", "left").select("user_id", "boundaries", "phase_only", "no_change", F.col("off").isNull().alias("agrees"))
