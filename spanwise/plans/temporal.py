"""Queries on time: joins, decoding, matching, runs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import intervals, matching, segmentation, signal
from .base import CURVE, GAP, HOUR, SEGMENTS, TOL, TRUTH, Book, curve, r6, segments, truth

book = Book()
WITH = f"WITH {SEGMENTS}, {TRUTH}"
U = ["user_id"]

# the greedy folds in SQL, over lists in the same order
PEAKS = f"""{CURVE}, edges AS (SELECT *, lag(prob) OVER w AS b, lead(prob) OVER w AS a FROM curve WINDOW w AS (PARTITION BY user_id ORDER BY t, i)),
peaks AS (SELECT user_id, i, t, prob FROM edges WHERE (b IS NULL OR prob >= b) AND (a IS NULL OR prob >= a)),
high AS (SELECT * FROM peaks WHERE prob >= 35),
lists AS (SELECT user_id, list({{'s': -prob, 'i': i, 't': t}} ORDER BY -prob, i) AS p FROM high GROUP BY user_id),
folded AS (SELECT user_id, list_reduce(list_transform(p, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: abs(q.t - x[1].t) < {GAP})) = 0 THEN list_concat(acc, x) ELSE acc END) AS kept, p FROM lists)"""


def peaks(spark, d):
    return signal.local_maxima(curve(spark, d), U, ["t", "i"], "prob")


def decoded(spark, d):
    return signal.suppress(peaks(spark, d).where("prob >= 35"), U, "t", "i", "prob", GAP)


@book.add("v01_local_maxima", f"WITH {PEAKS} SELECT user_id, i, t, prob FROM peaks")
def v01(spark, d):
    return peaks(spark, d).select("user_id", "i", "t", "prob")


@book.add("v02_threshold_nms", f"WITH {PEAKS} SELECT user_id, k.i AS i, k.t AS t, -k.s AS score FROM (SELECT user_id, unnest(kept) AS k FROM folded) x")
def v02(spark, d):
    return decoded(spark, d)


@book.add("v03_topk_nms", f"WITH {PEAKS}, cut AS (SELECT user_id, list_slice(kept, 1, 5) AS k5 FROM folded) SELECT user_id, k.i AS i, k.t AS t, -k.s AS score FROM (SELECT user_id, unnest(k5) AS k FROM cut) x")
def v03(spark, d):
    return signal.suppress(peaks(spark, d).where("prob >= 35"), U, "t", "i", "prob", GAP, F.lit(5))


@book.add("v03_adaptive_topk", f"WITH {PEAKS}, spans AS (SELECT user_id, CAST(round_even((max(t) - min(t)) / 259200, 0) AS BIGINT) AS k FROM curve GROUP BY user_id), cut AS (SELECT user_id, list_slice(kept, 1, greatest(k, 0)) AS ks FROM folded JOIN spans USING (user_id)) SELECT user_id, k.i AS i, k.t AS t FROM (SELECT user_id, unnest(ks) AS k FROM cut) x")
def v03_adaptive(spark, d):
    spans = curve(spark, d).groupBy("user_id").agg(F.bround((F.max("t") - F.min("t")) / 259200, 0).cast("long").alias("k"))
    high = peaks(spark, d).where("prob >= 35").join(spans, "user_id")
    return signal.suppress(high, U, "t", "i", "prob", GAP, F.max("k")).select("user_id", "i", "t")


@book.add("v04_nms_blockers", f"WITH {PEAKS} SELECT user_id, x.i AS i, list_contains(list_transform(kept, lambda q: q.i), x.i) AS kept, CASE WHEN list_contains(list_transform(kept, lambda q: q.i), x.i) THEN NULL ELSE list_transform(list_filter(kept, lambda q: abs(q.t - x.t) < {GAP}), lambda q: q.i)[1] END AS blocker FROM (SELECT user_id, kept, unnest(p) AS x FROM folded) y")
def v04(spark, d):
    return signal.suppressors(peaks(spark, d).where("prob >= 35"), U, "t", "i", "prob", GAP)


@book.add("flagship_boundary_f1")
def flagship(spark, d):
    """Decode each user's value curve and match its peaks with purchases (V01, V02, J16)."""
    c = curve(spark, d)
    high = signal.local_maxima(c, U, ["t", "i"], "prob").join(c.groupBy("user_id").agg(F.percentile("prob", 0.75).alias("p75")), "user_id").where("prob >= p75")
    kept = signal.suppress(high, U, "t", "i", "prob", GAP)
    return matching.match_at(kept, truth(spark, d).withColumnRenamed("u", "t"), U, "t", TOL).select("user_id", "n_pred", "n_gt", "tp", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@book.add("j16_sequential_match")
def j16(spark, d):
    got = matching.match_at(decoded(spark, d).select("user_id", "t"), truth(spark, d).withColumnRenamed("u", "t"), U, "t", TOL)
    return got.select("user_id", "n_pred", "n_gt", "tp", r6("f1").alias("f1"))


@book.add("j05_tolerance_join", f"{WITH} SELECT c.user_id, c.i, g.g, abs(c.t - g.u) AS gap FROM curve c JOIN truth g ON c.user_id = g.user_id AND abs(c.t - g.u) <= {TOL} WHERE c.label = 'click'")
def j05(spark, d):
    left = curve(spark, d).where("label = 'click'")
    return intervals.tolerance_join(left, truth(spark, d), U, "t", "u", TOL).select("user_id", "i", "g", F.abs(F.col("t") - F.col("u")).alias("gap"))


NEAREST = f"""{WITH}, near AS (SELECT c.user_id, c.i, arg_min(g.u, {{'d': abs(c.t - g.u), 'u': g.u}}) AS u_nearest, min(abs(c.t - g.u)) AS distance FROM curve c LEFT JOIN truth g ON c.user_id = g.user_id WHERE c.label = 'click' GROUP BY c.user_id, c.i)"""


@book.add("j06_nearest_join", f"{NEAREST} SELECT user_id, i, u_nearest, distance FROM near")
def j06(spark, d):
    return intervals.nearest(curve(spark, d).where("label = 'click'"), truth(spark, d), U, "t", "u", ["i"], ["g"]).select("user_id", "i", "u_nearest", "distance")


@book.add("j07_best_in_window", f"{WITH} SELECT g.user_id, g.g, max(c.prob) AS best_score, arg_min(c.t, {{'p': -c.prob, 't': c.t}}) AS best_t FROM truth g LEFT JOIN curve c ON c.user_id = g.user_id AND abs(c.t - g.u) <= {TOL} GROUP BY g.user_id, g.g")
def j07(spark, d):
    c = curve(spark, d).select("user_id", "t", "prob")
    return intervals.best_within(truth(spark, d), c, U, "u", "t", TOL, "prob", ["g"]).select("user_id", "g", "best_score", "best_t")


def view_segments(spark, d):
    return segments(spark, d).where("label = 'view'")


@book.add("j08_containing_segment", f"{WITH} SELECT g.user_id, g.g, arg_min(s.seg, {{'s': s.s, 'e': s.e}}) AS seg FROM truth g LEFT JOIN segments s ON s.user_id = g.user_id AND g.u >= s.s AND g.u <= s.e GROUP BY g.user_id, g.g")
def j08(spark, d):
    return intervals.containing(truth(spark, d), segments(spark, d), U, "u", "s", "e", ["g"], ["seg"], 12 * HOUR).select("user_id", "g", "seg")


@book.add("j09_previous_next", f"{WITH} SELECT g.user_id, g.g, arg_max(s.label, {{'e': s.e, 'l': s.label}}) FILTER (WHERE s.e <= g.u) AS previous_label, arg_min(s.label, {{'s': s.s, 'l': s.label}}) FILTER (WHERE s.s >= g.u) AS next_label FROM truth g LEFT JOIN segments s ON s.user_id = g.user_id GROUP BY g.user_id, g.g")
def j09(spark, d):
    return intervals.previous_next(truth(spark, d), segments(spark, d), U, "u", "s", "e", ["g"], "label").select("user_id", "g", "previous_label", "next_label")


@book.add("j10_edge_label_join", f"{WITH} SELECT g.user_id, g.g, arg_min(s.label, {{'d': abs(s.s - g.u), 's': s.seg}}) AS label, count(s.seg) AS n FROM truth g LEFT JOIN segments s ON s.user_id = g.user_id AND abs(s.s - g.u) <= 0.05 GROUP BY g.user_id, g.g")
def j10(spark, d):
    pairs = intervals.tolerance_join(truth(spark, d), segments(spark, d), U, "u", "s", 0.05, "left")
    return pairs.groupBy("user_id", "g").agg(F.min_by("label", F.struct(F.abs(F.col("s") - F.col("u")), "seg")).alias("label"), F.count("seg").alias("n"))


@book.add("j11_junction_join", f"{WITH} SELECT g.user_id, g.g, a.label AS ends, b.label AS starts FROM truth g JOIN segments a ON a.user_id = g.user_id AND abs(a.e - g.u) <= 60 JOIN segments b ON b.user_id = g.user_id AND abs(b.s - g.u) <= 60 AND b.label <> a.label")
def j11(spark, d):
    s = segments(spark, d)
    ends = intervals.tolerance_join(truth(spark, d), s.select("user_id", "e", F.col("label").alias("ends")), U, "u", "e", 60.0)
    both = intervals.tolerance_join(ends, s.select("user_id", "s", F.col("label").alias("starts")), U, "u", "s", 60.0)
    return both.where("ends <> starts").select("user_id", "g", "ends", "starts")


@book.add("j12_adjacent_segments", f"{WITH} SELECT user_id, seg, label, next_label FROM (SELECT *, lead(label) OVER w AS next_label, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM segments WINDOW w AS (PARTITION BY user_id ORDER BY s, e)) q WHERE ns - e <= 1 AND ne - s <= 43200 AND next_label <> label")
def j12(spark, d):
    return intervals.adjacent(segments(spark, d), U, "s", "e", "label", 1.0, 12 * HOUR).select("user_id", "seg", "label", "next_label")


@book.add("j13_interval_distance", f"{WITH} SELECT g.user_id, g.g, s.seg, round(greatest(s.s - g.u, g.u - s.e, 0), 6) AS distance, round(CASE WHEN g.u < s.s THEN g.u - s.s WHEN g.u > s.e THEN g.u - s.e ELSE 0 END, 6) AS signed FROM truth g JOIN segments s ON s.user_id = g.user_id")
def j13(spark, d):
    # all pairs are the result; the nearest segment of each time is j08 and j09
    pairs = truth(spark, d).join(segments(spark, d), "user_id")
    u, s, e = F.col("u"), F.col("s"), F.col("e")
    return pairs.select("user_id", "g", "seg", r6(sc.interval_distance(u, s, e)).alias("distance"), r6(sc.signed_distance(u, s, e)).alias("signed"))


@book.add("j14_association", f"{WITH}, p AS (SELECT g.user_id, g.g, c.i, c.t - g.u AS o, row_number() OVER (PARTITION BY g.user_id, g.g ORDER BY abs(c.t - g.u), c.t) AS r FROM truth g JOIN curve c ON c.user_id = g.user_id AND c.label = 'click' AND abs(c.t - g.u) <= 86400) SELECT user_id, g, i, r AS rank, CASE WHEN r > 1 THEN 'DUPLICATE' WHEN abs(o) <= {TOL} THEN 'ALIGNED' WHEN o < 0 THEN 'EARLY' ELSE 'LATE' END AS status FROM p")
def j14(spark, d):
    clicks = curve(spark, d).where("label = 'click'").select("user_id", "i", "t")
    return intervals.associate(truth(spark, d), clicks, U, "u", "t", ["g"], 24 * HOUR, TOL).select("user_id", "g", "i", F.col("rank").cast("long").alias("rank"), "status")


def predicted(spark, d):
    """Predicted segments: views, three hours longer."""
    return segments(spark, d).where("label = 'view'").select("user_id", F.col("seg").alias("p"), "s", (F.col("e") + 3 * HOUR).alias("e"))


def annotated(spark, d):
    """True segments: clicks, from three hours before."""
    return segments(spark, d).where("label = 'click'").select("user_id", F.col("seg").alias("g"), (F.col("s") - 3 * HOUR).alias("gs"), F.col("e").alias("ge"))


def iou_candidates(spark, d):
    return segmentation.candidates(predicted(spark, d), annotated(spark, d), U)


IOU = f"""{WITH}, c AS (SELECT a.user_id, a.seg AS p, b.seg AS g, round(greatest(least(a.e + 10800, b.e) - greatest(a.s, b.s - 10800), 0) / (greatest(a.e + 10800, b.e) - least(a.s, b.s - 10800)), 9) AS iou FROM segments a JOIN segments b ON a.user_id = b.user_id AND a.label = 'view' AND b.label = 'click' AND b.s - 10800 <= a.e + 10800 AND b.e >= a.s)"""


@book.add("j15_greedy_iou_match", f"{IOU}, l AS (SELECT user_id, list({{'s': -iou, 'i': -p, 'j': -g}} ORDER BY -iou, -p, -g) AS c FROM c WHERE iou > 0.1 GROUP BY user_id), f AS (SELECT user_id, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.i = x[1].i OR k.j = x[1].j)) = 0 THEN list_concat(acc, x) ELSE acc END) AS k FROM l) SELECT user_id, -k.i AS p, -k.j AS g, -k.s AS iou FROM (SELECT user_id, unnest(k) AS k FROM f) q")
def j15(spark, d):
    return matching.greedy_pairs(iou_candidates(spark, d).where("iou > 0.1"), U, "iou", "p", "g", (F.least("s", "gs"), F.greatest("e", "ge")))


@book.add("g01_g02_g07_interval_scores", f"{WITH} SELECT a.user_id, a.seg, round(greatest(least(a.e, b.e + 600) - greatest(a.s, b.s + 300), 0) / (greatest(a.e, b.e + 600) - least(a.s, b.s + 300)), 6) AS iou, round(greatest(0, greatest(least(a.e, b.e + 600) - greatest(a.s, b.s + 300), 0) / (greatest(a.e, b.e + 600) - least(a.s, b.s + 300)) * (1 - abs(a.s - b.s - 300) / (b.e + 300 - b.s)) * (1 - abs(a.e - b.e - 600) / (b.e + 300 - b.s))), 6) AS aligned FROM segments a JOIN segments b ON a.user_id = b.user_id AND a.seg = b.seg WHERE a.e > a.s")
def g01(spark, d):
    s, e = F.col("s"), F.col("e")
    b0, b1 = s + 300, e + 600
    return segments(spark, d).where("e > s").select("user_id", "seg", r6(sc.iou_hull(s, e, b0, b1)).alias("iou"), r6(sc.alignment(s, e, b0, b1)).alias("aligned"))


@book.add("v08_segment_edges", f"{WITH}, b AS (SELECT DISTINCT user_id, round(x, 3) AS b FROM (SELECT user_id, s AS x FROM segments UNION ALL SELECT user_id, e FROM segments) q), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM b) SELECT user_id, b FROM r WHERE k > 1 AND k < n")
def v08(spark, d):
    s = segments(spark, d)
    edges = s.select("user_id", F.round("s", 3).alias("b")).union(s.select("user_id", F.round("e", 3))).distinct()
    w = W.partitionBy("user_id")
    return edges.withColumn("k", F.row_number().over(w.orderBy("b"))).withColumn("n", F.count(F.lit(1)).over(w)).where("k > 1 AND k < n").select("user_id", "b")


@book.add("v09_gap_midpoints", f"{WITH}, v AS (SELECT user_id, seg, s, e, lead(s) OVER (PARTITION BY user_id ORDER BY s, e) AS n FROM segments WHERE label IN ('view', 'click')) SELECT user_id, seg, CASE WHEN n - e > 0 THEN (e + n) / 2 ELSE e END AS boundary FROM v WHERE n IS NOT NULL")
def v09(spark, d):
    v = segments(spark, d).where("label IN ('view', 'click')").withColumn("n", F.lead("s").over(W.partitionBy("user_id").orderBy("s", "e")))
    return v.where("n IS NOT NULL").select("user_id", "seg", F.when(F.col("n") > F.col("e"), (F.col("e") + F.col("n")) / 2).otherwise(F.col("e")).alias("boundary"))


@book.add("v10_interior_boundaries", f"{WITH} SELECT user_id, g FROM (SELECT g.*, c.lo, c.hi FROM truth g JOIN (SELECT user_id, min(t) AS lo, max(t) AS hi FROM curve GROUP BY user_id) c USING (user_id)) q WHERE u >= lo + 86400 AND u <= hi - 86400")
def v10(spark, d):
    span = curve(spark, d).groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return truth(spark, d).join(span, "user_id").where((F.col("u") >= F.col("lo") + 24 * HOUR) & (F.col("u") <= F.col("hi") - 24 * HOUR)).select("user_id", "g")


@book.add("v11_soft_boundary", f"{WITH} SELECT c.user_id, c.i, round(coalesce(max(exp(-((c.t - g.u) * (c.t - g.u)) / (2 * 10800.0 * 10800.0))), 0), 6) AS soft FROM curve c LEFT JOIN truth g ON c.user_id = g.user_id AND abs(c.t - g.u) <= 54000 GROUP BY c.user_id, c.i")
def v11(spark, d):
    # beyond five sigma the target is under 4e-6
    sigma = 3 * HOUR
    pairs = intervals.tolerance_join(curve(spark, d), truth(spark, d), U, "t", "u", 5 * sigma, "left")
    return pairs.groupBy("user_id", "i").agg(r6(F.coalesce(F.max(F.exp(-((F.col("t") - F.col("u")) ** 2) / (2 * sigma**2))), F.lit(0.0))).alias("soft"))


@book.add("v12_actionness", f"{WITH} SELECT c.user_id, c.i, CAST(c.t >= a.lo AND c.t <= a.hi AS INTEGER) AS inside FROM curve c JOIN (SELECT user_id, min(u) AS lo, max(u) AS hi FROM truth GROUP BY user_id) a USING (user_id)")
def v12(spark, d):
    span = truth(spark, d).groupBy("user_id").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    return curve(spark, d).join(span, "user_id").select("user_id", "i", F.col("t").between(F.col("lo"), F.col("hi")).cast("int").alias("inside"))


@book.add("v14_moving_average", f"WITH {CURVE} SELECT user_id, i, round(sum(prob) OVER (PARTITION BY user_id ORDER BY t, i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smooth FROM curve")
def v14(spark, d):
    return curve(spark, d).select("user_id", "i", r6(signal.smoothed(curve(spark, d), U, ["t", "i"], "prob", 3)).alias("smooth"))


@book.add("v15_temporal_deltas", f"WITH {CURVE} SELECT user_id, i, round(coalesce(prob - lag(prob) OVER w, 0), 6) AS delta1, round(coalesce(lead(prob) OVER w - lag(prob) OVER w, 0), 6) AS delta_sym FROM curve WINDOW w AS (PARTITION BY user_id ORDER BY t, i)")
def v15(spark, d):
    w = W.partitionBy("user_id").orderBy("t", "i")
    p = F.col("prob")
    return curve(spark, d).select("user_id", "i", r6(F.coalesce(p - F.lag("prob").over(w), F.lit(0.0))).alias("delta1"), r6(F.coalesce(F.lead("prob").over(w) - F.lag("prob").over(w), F.lit(0.0))).alias("delta_sym"))


HOLES = f"WITH {CURVE}, h AS (SELECT user_id, i, t, CASE WHEN i % 3 = 0 THEN NULL ELSE prob END AS x FROM curve)"


def holes(spark, d):
    return curve(spark, d).select("user_id", "i", "t", F.when(F.col("i") % 3 != 0, F.col("prob")).alias("x"))


@book.add("v16_gap_interpolation", f"{HOLES}, n AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta, last_value(x IGNORE NULLS) OVER b AS xa, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tb, first_value(x IGNORE NULLS) OVER f AS xb FROM h WINDOW b AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, i, coalesce(x IS NULL AND tb - ta <= 86400, false) AS filled, round(CASE WHEN x IS NOT NULL THEN x WHEN tb - ta <= 86400 THEN xa + (xb - xa) * (t - ta) / (tb - ta) END, 6) AS x_filled FROM n")
def v16(spark, d):
    return signal.fill_gaps(holes(spark, d), U, "t", "x", 24 * HOUR).select("user_id", "i", "filled", r6("x_filled").alias("x_filled"))


RUNS = f"WITH {CURVE}, st AS (SELECT user_id, i, t, CASE WHEN label IN ('view', 'click') THEN 'contact' WHEN label = 'error' THEN NULL ELSE 'free' END AS state FROM curve), n AS (SELECT *, CASE WHEN state IS NOT NULL AND coalesce(lag(state) OVER w, '') <> state THEN 1 ELSE 0 END AS new FROM st WINDOW w AS (PARTITION BY user_id ORDER BY t, i)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS run FROM n), runs AS (SELECT user_id, CAST(run AS BIGINT) AS run, state, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM r WHERE state IS NOT NULL GROUP BY user_id, run, state)"


def contact_runs(spark, d):
    state = F.when(F.col("label").isin("view", "click"), "contact").when(F.col("label") != "error", "free")
    return signal.runs(curve(spark, d).withColumn("state", state), U, ["t", "i"], "state", "t")


@book.add("v18_run_lengths", f"{RUNS} SELECT user_id, run, state, first_t, last_t, n FROM runs")
def v18(spark, d):
    return contact_runs(spark, d).select("user_id", F.col("run").cast("long").alias("run"), "state", "first_t", "last_t", "n")


@book.add("v19_reset_events", f"{RUNS}, l AS (SELECT *, lag(state) OVER w AS p1, lag(n) OVER w AS n1, lag(state, 2) OVER w AS p2, lag(first_t) OVER w AS f1 FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY run)) SELECT user_id, run, f1 AS released_t, first_t AS regained_t FROM l WHERE state = 'contact' AND p1 = 'free' AND p2 = 'contact' AND n1 >= 2")
def v19(spark, d):
    w = W.partitionBy("user_id").orderBy("run")
    r = contact_runs(spark, d).withColumn("p1", F.lag("state").over(w)).withColumn("n1", F.lag("n").over(w)).withColumn("p2", F.lag("state", 2).over(w)).withColumn("released_t", F.lag("first_t").over(w))
    return r.where("state = 'contact' AND p1 = 'free' AND p2 = 'contact' AND n1 >= 2").select("user_id", F.col("run").cast("long").alias("run"), "released_t", F.col("first_t").alias("regained_t"))


@book.add("v20_continuity_evidence", f"{RUNS} SELECT user_id, round(sum(CASE WHEN state = 'contact' THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS held, count(*) FILTER (WHERE state = 'contact') AS held_runs, max(CASE WHEN state = 'contact' THEN n ELSE 0 END) AS longest_held FROM runs GROUP BY user_id")
def v20(spark, d):
    held = F.col("state") == "contact"
    return contact_runs(spark, d).groupBy("user_id").agg(r6(F.sum(F.when(held, F.col("n")).otherwise(0)) / F.sum("n")).alias("held"), F.count_if(held).alias("held_runs"), F.max(F.when(held, F.col("n")).otherwise(0)).alias("longest_held"))


@book.add("v21_longest_gap", f"WITH {CURVE} SELECT user_id, max(s) AS longest_gap FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS s FROM curve) q GROUP BY user_id")
def v21(spark, d):
    return signal.gaps(curve(spark, d), U, "t")


@book.add("v28_neighbour_bounds", f"{WITH} SELECT c.user_id, c.i, max(g.u) FILTER (WHERE g.u < c.t - 1e-7) AS low, min(g.u) FILTER (WHERE g.u > c.t + 1e-7) AS high FROM curve c LEFT JOIN truth g ON c.user_id = g.user_id GROUP BY c.user_id, c.i")
def v28(spark, d):
    return intervals.neighbour_bounds(curve(spark, d), truth(spark, d), U, "t", "u", ["i"]).select("user_id", "i", "low", "high")


@book.add("v29_grid_resample", f"{WITH}, b AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM curve GROUP BY user_id), gr AS (SELECT user_id, lo, unnest(generate_series(0, CAST(floor((hi - lo) / 86400) AS BIGINT))) AS k FROM b), x AS (SELECT gr.user_id, gr.k, arg_min(c.prob, {{'d': abs(c.t - gr.lo - gr.k * 86400), 't': c.t}}) AS prob, min(abs(c.t - gr.lo - gr.k * 86400)) AS dd FROM gr JOIN curve c ON c.user_id = gr.user_id GROUP BY gr.user_id, gr.k) SELECT user_id, CAST(k AS INTEGER) AS k, dd <= {TOL} AS valid, CASE WHEN dd <= {TOL} THEN prob END AS prob FROM x")
def v29(spark, d):
    c = curve(spark, d)
    g = signal.grid(c.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")), "lo", "hi", 24 * HOUR)
    near = intervals.nearest(g, c, U, "grid_t", "t", ["k"], ["prob"], TOL)
    return near.select("user_id", "k", F.col("prob").isNotNull().alias("valid"), "prob")


@book.add("v31_duplicate_claims", f"{NEAREST} SELECT user_id, i, row_number() OVER (PARTITION BY user_id, u_nearest ORDER BY distance, i) > 1 AS duplicate FROM near WHERE distance <= 86400")
def v31(spark, d):
    near = intervals.nearest(curve(spark, d).where("label = 'click'"), truth(spark, d), U, "t", "u", ["i"], ["g"], 24 * HOUR).where("distance IS NOT NULL")
    return near.select("user_id", "i", (F.row_number().over(W.partitionBy("user_id", "u_nearest").orderBy("distance", "i")) > 1).alias("duplicate"))


@book.add("v32_span_coverage", f"{WITH}, w AS (SELECT user_id, s, e + 7200 AS e FROM segments WHERE label = 'view'), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w) SELECT user_id, round(sum(greatest(e - greatest(s, coalesce(p, s)), 0)), 3) AS covered, round(sum(e - s) - sum(greatest(e - greatest(s, coalesce(p, s)), 0)), 3) AS shared FROM m GROUP BY user_id")
def v32(spark, d):
    w = view_segments(spark, d).withColumn("e", F.col("e") + 2 * HOUR)
    return intervals.covered(w, U, "s", "e").select("user_id", F.round("covered", 3).alias("covered"), F.round("shared", 3).alias("shared"))


@book.add("a12_offset_distribution", f"{NEAREST} SELECT user_id, round(quantile_cont(distance, 0.5), 6) AS median, round(avg(distance), 6) AS mean, round(avg(CASE WHEN distance <= 21600 THEN 1.0 ELSE 0.0 END), 6) AS within_6h, round(avg(CASE WHEN distance <= 86400 THEN 1.0 ELSE 0.0 END), 6) AS within_24h FROM near WHERE distance IS NOT NULL GROUP BY user_id")
def a12(spark, d):
    near = intervals.nearest(curve(spark, d).where("label = 'click'"), truth(spark, d), U, "t", "u", ["i"], ["g"]).where("distance IS NOT NULL")
    return near.groupBy("user_id").agg(r6(F.percentile("distance", 0.5)).alias("median"), r6(F.avg("distance")).alias("mean"), r6(F.avg((F.col("distance") <= 21600).cast("double"))).alias("within_6h"), r6(F.avg((F.col("distance") <= 86400).cast("double"))).alias("within_24h"))


STATUS = f"WITH {PEAKS}, {TRUTH}, kept AS (SELECT user_id, k.i AS i, k.t AS t, -k.s AS score FROM (SELECT user_id, unnest(kept) AS k FROM folded) x), near AS (SELECT g.user_id, g.g, min(abs(k.t - g.u)) AS d, arg_min(k.t - g.u, {{'d': abs(k.t - g.u), 't': k.t}}) AS o FROM truth g LEFT JOIN kept k ON k.user_id = g.user_id GROUP BY g.user_id, g.g), best AS (SELECT g.user_id, g.g, max(c.prob) AS p FROM truth g LEFT JOIN curve c ON c.user_id = g.user_id AND abs(c.t - g.u) <= {TOL} GROUP BY g.user_id, g.g)"
CASES = "CASE WHEN d <= 3600 THEN 'exact' WHEN d <= 21600 AND o < 0 THEN 'early' WHEN d <= 21600 THEN 'late' WHEN p >= 35 THEN 'missed_signal_present' ELSE 'missed_weak_signal' END"


@book.add("v05_boundary_taxonomy", f"{STATUS} SELECT user_id, g, {CASES} AS status FROM near JOIN best USING (user_id, g)")
def v05(spark, d):
    g = truth(spark, d)
    near = intervals.nearest(g, decoded(spark, d).select("user_id", "t", "score"), U, "u", "t", ["g"], ["score"]).withColumn("o", F.col("t_nearest") - F.col("u"))
    best = intervals.best_within(g, curve(spark, d).select("user_id", "t", "prob"), U, "u", "t", TOL, "prob", ["g"]).select("user_id", "g", "best_score")
    status = F.when(F.col("distance") <= HOUR, "exact").when((F.col("distance") <= TOL) & (F.col("o") < 0), "early").when(F.col("distance") <= TOL, "late").when(F.col("best_score") >= 35, "missed_signal_present").otherwise("missed_weak_signal")
    return near.join(best, ["user_id", "g"]).select("user_id", "g", status.alias("status"))


@book.add("a11_status_counts", f"{STATUS} SELECT {CASES} AS status, count(*) AS n FROM near JOIN best USING (user_id, g) GROUP BY 1")
def a11(spark, d):
    return v05(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@book.add("a07_segment_f1", f"{IOU}, l AS (SELECT user_id, list({{'s': -iou, 'i': -p, 'j': -g}} ORDER BY -iou, -p, -g) AS c FROM c WHERE iou > 0.3 GROUP BY user_id), f AS (SELECT user_id, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.i = x[1].i OR k.j = x[1].j)) = 0 THEN list_concat(acc, x) ELSE acc END) AS k FROM l), n AS (SELECT user_id, count(*) FILTER (WHERE label = 'view') AS np, count(*) FILTER (WHERE label = 'click') AS ng FROM segments GROUP BY user_id) SELECT user_id, np AS n_pred, ng AS n_gt, coalesce(len(k), 0) AS tp, round(CASE WHEN np + ng > 0 THEN 2 * coalesce(len(k), 0) / CAST(np + ng AS DOUBLE) ELSE 0 END, 6) AS f1 FROM n LEFT JOIN f USING (user_id)")
def a07(spark, d):
    tp = matching.greedy_pairs(iou_candidates(spark, d).where("iou > 0.3"), U, "iou", "p", "g", (F.least("s", "gs"), F.greatest("e", "ge"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("tp"))
    n = segments(spark, d).groupBy("user_id").agg(F.count_if(F.col("label") == "view").alias("n_pred"), F.count_if(F.col("label") == "click").alias("n_gt"))
    hits = F.coalesce("tp", F.lit(0))
    return n.join(tp, "user_id", "left").select("user_id", "n_pred", "n_gt", hits.alias("tp"), r6(sc.safe_ratio(2 * hits, F.col("n_pred") + F.col("n_gt"))).alias("f1"))


MATCHES = f"""{IOU}, l AS (SELECT user_id, list({{'s': -iou, 'i': -p, 'j': -g}} ORDER BY -iou, -p, -g) AS c FROM c WHERE iou > 0.1 GROUP BY user_id), f AS (SELECT user_id, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.i = x[1].i OR k.j = x[1].j)) = 0 THEN list_concat(acc, x) ELSE acc END) AS k FROM l), m AS (SELECT user_id, -k.i AS p, -k.j AS g, -k.s AS iou FROM (SELECT user_id, unnest(k) AS k FROM f) q),
pr AS (SELECT user_id, seg AS p, s, e + 10800 AS e FROM segments WHERE label = 'view'), gt AS (SELECT user_id, seg AS g, s - 10800 AS gs, e AS ge FROM segments WHERE label = 'click'), dur AS (SELECT user_id, max(t) - min(t) AS d FROM curve GROUP BY user_id),
sc AS (SELECT user_id, count(*) FILTER (WHERE iou >= 0.3) AS t3, count(*) FILTER (WHERE iou >= 0.5) AS t5, count(*) FILTER (WHERE iou >= 0.7) AS t7, avg(iou) AS mi, sum(iou * greatest((1 - abs(gs - s) / d) * (1 - abs(ge - e) / d), 0)) AS comp FROM m JOIN pr USING (user_id, p) JOIN gt USING (user_id, g) JOIN dur USING (user_id) GROUP BY user_id),
n AS (SELECT user_id, count(*) FILTER (WHERE label = 'view') AS np, count(*) FILTER (WHERE label = 'click') AS ng FROM segments WHERE label IN ('view', 'click') GROUP BY user_id), win AS (SELECT user_id, min(gs) AS t0, max(ge) AS t1 FROM gt GROUP BY user_id),
cl AS (SELECT user_id, greatest(s, t0) AS s, least(e, t1) AS e FROM pr JOIN win USING (user_id) WHERE least(e, t1) > greatest(s, t0)), rm AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM cl), cov AS (SELECT user_id, sum(greatest(e - greatest(s, coalesce(q, s)), 0)) AS covered FROM rm GROUP BY user_id),
ov AS (SELECT user_id, sum(greatest(e - nx, 0)) AS over, sum(e - s) AS total FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, e) AS nx FROM pr) q GROUP BY user_id),
x AS (SELECT n.user_id, np, ng, np > 0 AND ng > 0 AS ok, coalesce(t3, 0) AS t3, coalesce(t5, 0) AS t5, coalesce(t7, 0) AS t7, coalesce(mi, 0) AS mi, coalesce(comp, 0) AS comp, least(coalesce(covered, 0) / greatest(t1 - t0, 1e-6), 1) AS cv, least(coalesce(over, 0) / CASE WHEN total <> 0 THEN total ELSE 1e-6 END, 1) AS ol, greatest(1 - abs(np - ng) / CAST(nullif(ng, 0) AS DOUBLE), 0) AS ca FROM n LEFT JOIN sc USING (user_id) LEFT JOIN win USING (user_id) LEFT JOIN cov USING (user_id) LEFT JOIN ov USING (user_id))"""


@book.add("a07_segment_metrics", f"{MATCHES} SELECT user_id, np AS n_pred, ng AS n_gt, " + ", ".join(f"round(CASE WHEN ok THEN {v} ELSE 0 END, 6)::DOUBLE AS {k}" for k, v in {"f1_30": "2 * t3 / CAST(np + ng AS DOUBLE)", "f1_50": "2 * t5 / CAST(np + ng AS DOUBLE)", "f1_70": "2 * t7 / CAST(np + ng AS DOUBLE)", "mean_iou": "mi", "boundary": "comp / ng", "coverage": "cv", "overlap": "ol", "count_acc": "ca", "iou_reward": "comp / greatest(np, ng)", "seq_reward": "0.4 * cv + 0.3 * (1 - ol) + 0.3 * ca"}.items()) + " FROM x")
def a07_metrics(spark, d):
    span = curve(spark, d).groupBy("user_id").agg((F.max("t") - F.min("t")).alias("duration"))
    out = segmentation.metrics(predicted(spark, d), annotated(spark, d), U, span)
    return out.select("user_id", "n_pred", "n_gt", *[r6(c).alias(c) for c in out.columns[3:]])


@book.add("a45_recall_by_budget", f"WITH {PEAKS}, {TRUTH}, budgets AS (SELECT unnest([1, 3, 5, 10]) AS budget), cut AS (SELECT user_id, budget, list_slice(kept, 1, budget) AS ks FROM folded, budgets), pred AS (SELECT user_id, budget, k.t AS t FROM (SELECT user_id, budget, unnest(ks) AS k FROM cut) x), hit AS (SELECT b.budget, g.user_id, g.g, count(p.t) > 0 AS h FROM truth g CROSS JOIN budgets b LEFT JOIN pred p ON p.user_id = g.user_id AND p.budget = b.budget AND abs(p.t - g.u) <= {TOL} GROUP BY b.budget, g.user_id, g.g) SELECT budget, count(*) AS n_gt, round(avg(CASE WHEN h THEN 1.0 ELSE 0.0 END), 6) AS recall FROM hit GROUP BY budget")
def a45(spark, d):
    budgets = spark.createDataFrame([(b,) for b in (1, 3, 5, 10)], "budget int")  # a stated list of four
    ranked = decoded(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("score").desc(), "i")))
    pred = ranked.join(F.broadcast(budgets), F.col("rank") <= F.col("budget")).select("user_id", "budget", "t")
    asked = truth(spark, d).join(F.broadcast(budgets))
    hit = intervals.tolerance_join(asked, pred, ["user_id", "budget"], "u", "t", TOL, "left").groupBy("budget", "user_id", "g").agg((F.count("t") > 0).cast("double").alias("h"))
    return hit.groupBy("budget").agg(F.count(F.lit(1)).alias("n_gt"), r6(F.avg("h")).alias("recall"))


@book.add("p14_frame_drop_policies", f"WITH {CURVE}, {TRUTH}, pol AS (SELECT unnest(['every_2nd', 'high_only']) AS policy), keptf AS (SELECT policy, user_id, t FROM curve, pol WHERE (policy = 'every_2nd' AND i % 2 = 0) OR (policy = 'high_only' AND prob >= 35)), m AS (SELECT k.policy, g.user_id, g.g, min(abs(k.t - g.u)) AS d FROM truth g JOIN keptf k ON k.user_id = g.user_id GROUP BY k.policy, g.user_id, g.g) SELECT policy, count(*) AS n, round(avg(CASE WHEN d <= {TOL} THEN 1.0 ELSE 0.0 END), 6) AS survive FROM m GROUP BY policy")
def p14(spark, d):
    policies = {"every_2nd": F.col("i") % 2 == 0, "high_only": F.col("prob") >= 35}
    out = None
    for name, keep in policies.items():
        near = intervals.nearest(truth(spark, d), curve(spark, d).where(keep).select("user_id", "t", "i"), U, "u", "t", ["g"], ["i"]).where("distance IS NOT NULL")
        one = near.agg(F.lit(name).alias("policy"), F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("distance") <= TOL).cast("double"))).alias("survive"))
        out = one if out is None else out.unionByName(one)
    return out


@book.add("w10_coverage_in_window", f"{WITH} SELECT g.user_id, g.g, round(avg(CASE WHEN c.prob >= 35 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM truth g JOIN curve c ON c.user_id = g.user_id AND abs(c.t - g.u) <= 86400 GROUP BY g.user_id, g.g")
def w10(spark, d):
    pairs = intervals.tolerance_join(truth(spark, d), curve(spark, d).select("user_id", "t", "prob"), U, "u", "t", 24 * HOUR)
    return pairs.groupBy("user_id", "g").agg(r6(F.avg((F.col("prob") >= 35).cast("double"))).alias("coverage"))


@book.add("j23_fuzzy_key_join", f"{WITH}, p AS (SELECT g.user_id, g.g, c.t, abs(c.t - g.u) AS dd, row_number() OVER (PARTITION BY g.user_id, g.g ORDER BY abs(c.t - g.u), c.t) AS r FROM truth g JOIN curve c ON c.user_id = g.user_id AND c.label = 'click'), o AS (SELECT user_id, g, min(dd) FILTER (WHERE r = 1) AS d1, min(dd) FILTER (WHERE r = 2) AS d2, min(t) FILTER (WHERE r = 1) AS m FROM p WHERE r <= 2 GROUP BY user_id, g) SELECT user_id, g, m AS match FROM o WHERE d1 <= 60 OR (d1 <= 43200 AND (d2 IS NULL OR d2 > 5 * d1))")
def j23(spark, d):
    clicks = curve(spark, d).where("label = 'click'").select("user_id", "t")
    return intervals.fuzzy_match(truth(spark, d), clicks, U, "u", "t", ["g"], 60.0, 12 * HOUR, 5.0).select("user_id", "g", "match")
