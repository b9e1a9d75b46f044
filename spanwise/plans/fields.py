"""Queries on fields that are derived from observations, replies and policies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import fields, motion, rules
from ..session import table
from .audits import ACTIONS, FITS
from .base import SCORED, Book, scored

book = Book()
ONTO = fields.Ontology({"the": "take", "and": "add", "is": "place", "of": "open", "on": "put"}, {"to": "cup", "in": "drawer", "that": "lid", "a": "cup"}, {"take": ["place", "put"], "open": ["add"]}, ("put", "add"))


def words_sql(text):
    return f"regexp_extract_all(lower({text}), '[a-z]+')"


def named_sql(text, names):
    """The canonical names in a text, in order, in SQL."""
    return f"list_filter(list_transform({words_sql(text)}, lambda w: CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in names.items()) + " END), lambda w: w IS NOT NULL)"


def seen(spark, d):
    """Turns as labels; what was seen is what the next turn says: ``conv_id, turn, text, verb, thing, more``."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("next", F.lead("text").over(w))
    first = F.try_element_at(F.filter(F.regexp_extract_all(F.lower("next"), F.lit("[a-z]+"), F.lit(0)), lambda x: x.isin(*ONTO.verbs)), F.lit(1))
    verb = F.when(F.col("turn") % 5 == 4, "tak").when(F.length("next") % 7 != 0, first)
    return rows.select("conv_id", "turn", "role", "text", verb.alias("verb"), ONTO.first_object(F.col("next")).alias("thing"), (F.size(ONTO.label_verbs(F.col("next"))) > 3).alias("more"))


UNDONE = ", ".join(f"'{a} {b}'" for x, ys in ONTO.inverse.items() for y in ys for a, b in ((x, y), (y, x)))
GENERIC = ", ".join(f"'{g}'" for g in ONTO.generic)
SEEN = f"""n AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
o AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 5 = 4 THEN 'tak' WHEN length(next) % 7 <> 0 THEN list_filter({words_sql('next')}, lambda x: x IN ({', '.join(f"'{k}'" for k in ONTO.verbs)}))[1] END AS verb, {named_sql('next', ONTO.objects)}[1] AS thing, len({named_sql('next', ONTO.verbs)}) > 3 AS more, {named_sql('text', ONTO.verbs)} AS vs, {named_sql('text', ONTO.objects)}[1] AS lo FROM n),
k AS (SELECT *, {named_sql('verb', ONTO.verbs)}[1] AS known FROM o),
r AS (SELECT *, list_transform(vs, lambda v: CASE WHEN verb IS NULL THEN 'unknown' WHEN verb = v OR coalesce(known = v, false) THEN 'same' WHEN known IS NOT NULL THEN CASE WHEN known || ' ' || v IN ({UNDONE}) THEN 'incompatible' ELSE 'unknown' END WHEN contains(v, verb) OR contains(verb, v) THEN 'same' ELSE 'unknown' END) AS rel FROM k),
q AS (SELECT *, CASE WHEN list_contains(rel, 'same') THEN 'same' WHEN list_contains(rel, 'incompatible') THEN 'incompatible' ELSE 'unknown' END AS vr, CASE WHEN lo IS NULL OR thing IS NULL THEN 'unknown' WHEN lo = thing THEN 'same' ELSE 'wrong_object' END AS orl, len(list_filter(vs, lambda v: v IN ({GENERIC}))) > 0 AND NOT coalesce(known IN ({GENERIC}), false) AS coarse FROM r),
s AS (SELECT *, CASE WHEN vr = 'incompatible' OR orl = 'wrong_object' THEN 'bad' WHEN vr = 'same' THEN 'good' WHEN coarse THEN 'coarse' ELSE 'open' END AS how FROM q),
sem AS (SELECT conv_id, turn, role, text, CASE how WHEN 'bad' THEN 'contradicted' WHEN 'open' THEN 'uncertain' ELSE 'supported' END AS label_support,
  CASE WHEN how = 'bad' THEN CASE WHEN vr = 'incompatible' THEN 'incorrect' ELSE 'wrong_object' END WHEN how = 'open' THEN 'unresolved' WHEN coalesce(more, false) THEN 'missing_secondary' ELSE 'complete' END AS label_completeness,
  CASE WHEN how = 'bad' THEN 'not_applicable' WHEN how = 'good' THEN CASE WHEN coarse THEN 'too_coarse' ELSE 'appropriate' END WHEN how = 'coarse' THEN 'too_coarse' ELSE 'unresolved' END AS label_granularity, vr AS semantic_relation, orl AS object_relation FROM s)"""


def semantics(spark, d):
    rows = seen(spark, d)
    told = fields.semantic_fields(ONTO, F.col("verb"), F.col("thing"), F.col("more"), F.col("text"))
    return rows.select("conv_id", "turn", "role", "text", *[c.alias(n) for n, c in told.items()])


@book.add("r02_semantic_derivation", f"WITH {SEEN} SELECT conv_id, turn, label_support, label_completeness, label_granularity, semantic_relation, object_relation FROM sem")
def r02(spark, d):
    """How each label agrees with what was seen: five fields from verbs and objects."""
    return semantics(spark, d).drop("role", "text")


@book.add(
    "r03_three_pass_fusion",
    f"""WITH {SEEN}, p AS (SELECT *, CASE length(text) % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'spurious' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'odd' END AS truth, ['correctly_annotated', 'missing_from_gt', 'spurious_gt', 'gt_offset', 'multiple_valid', 'unresolved', 'odd'][turn % 7 + 1] AS relation, CASE WHEN length(text) % 3 = 0 THEN 'yes' ELSE 'no' END AS motion, CASE WHEN length(text) % 4 <> 0 THEN turn * 2.0 END AS t3, CASE WHEN role = 'user' THEN turn * 2.0 + 1 END AS t1 FROM sem),
  f AS (SELECT *, CASE WHEN truth IN ('valid', 'spurious', 'ambiguous') THEN truth ELSE 'unresolved' END AS t, CASE WHEN relation = 'odd' THEN 'unresolved' ELSE relation END AS rr, label_support = 'uncertain' OR label_completeness = 'unresolved' AS op, label_support = 'contradicted' OR label_completeness IN ('incorrect', 'wrong_object') AS rp FROM p),
  g AS (SELECT *, CASE WHEN t IN ('valid', 'ambiguous') THEN CASE WHEN t3 IS NULL THEN t1 WHEN t1 IS NULL THEN t3 ELSE (t1 + t3) / 2 END ELSE t3 END AS tm FROM f)
  SELECT conv_id, turn, t AS temporal_truth, rr AS gt_boundary_relation, CASE t WHEN 'spurious' THEN 'invalid' ELSE t END AS candidate_boundary_validity, CASE rr WHEN 'correctly_annotated' THEN 'keep' WHEN 'missing_from_gt' THEN 'add_boundary' WHEN 'spurious_gt' THEN 'remove_boundary' WHEN 'gt_offset' THEN 'shift_boundary' WHEN 'multiple_valid' THEN 'review_convention' ELSE 'exclude' END AS temporal_correction_action,
  CASE WHEN rp THEN 'replace_label' WHEN label_completeness = 'missing_secondary' THEN 'expand_or_soften' WHEN label_granularity = 'too_coarse' THEN 'collapse_granularity' WHEN op THEN 'exclude_or_review' ELSE 'keep' END AS semantic_correction_action, CASE WHEN op THEN 'exclude' WHEN rp THEN 'hard_negative' WHEN label_completeness = 'missing_secondary' OR label_granularity = 'too_coarse' THEN 'soft_positive' ELSE 'strong_positive' END AS naming_contrastive_role,
  CASE WHEN t = 'valid' THEN 'positive' WHEN t = 'spurious' AND motion = 'yes' THEN 'motion_hard_negative' ELSE 'exclude' END AS boundary_contrastive_role, round(CAST(tm AS DOUBLE), 2) AS corrected_time, t IN ('spurious', 'unresolved') AND tm IS NULL AS no_valid_boundary, t = 'unresolved' AS boundary_time_unresolved FROM g""",
)
def r03(spark, d):
    """Three passes over a boundary fused into its truth, actions and roles."""
    n, turn = F.length("text"), F.col("turn")
    relation = F.element_at(F.array(*map(F.lit, [*fields.TEMPORAL_ACTION, "odd"])), (turn % 7 + 1).cast("int"))
    truth = F.when(n % 5 == 0, "valid").when(n % 5 == 1, "spurious").when(n % 5 == 2, "ambiguous").when(n % 5 == 3, "odd")
    times = F.when(n % 4 != 0, turn * 2.0), F.when(F.col("role") == "user", turn * 2.0 + 1)
    told = fields.fused(truth, relation, F.when(n % 3 == 0, "yes").otherwise("no"), times, F.col("label_support"), F.col("label_completeness"), F.col("label_granularity"))
    return semantics(spark, d).select("conv_id", "turn", *[c.alias(k) for k, c in told.items()])


@book.add("s15_named_reply_fields", f"WITH w AS (SELECT conv_id, turn, role, text, {words_sql('text')} AS w, length(text) AS n FROM conversations), v AS (SELECT *, list_filter([CASE WHEN n % 4 <> 0 THEN CASE " + " ".join(f"WHEN lower(w[1]) = '{k}' THEN '{v}'" for k, v in ONTO.verbs.items()) + " END END] || CASE WHEN n % 3 <> 0 THEN list_transform(w[2:4], lambda x: CASE " + " ".join(f"WHEN x = '{k}' THEN '{v}'" for k, v in ONTO.verbs.items()) + f" END) ELSE [] END, lambda x: x IS NOT NULL) AS vs, {named_sql('CASE WHEN n % 6 <> 0 THEN w[5] ELSE text END', ONTO.objects)}[1] AS o FROM w) SELECT conv_id, turn, list_aggregate(list_transform(list_filter(range(1, len(vs) + 1), lambda i: NOT list_contains(vs[1:i - 1], vs[i])), lambda i: vs[i]), 'string_agg', ',') AS verbs, o AS object FROM v")
def s15(spark, d):
    """Verbs and object that replies name, some without a primary verb, secondary verbs or an object."""
    n = F.length("text")
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    at = lambda i: F.coalesce(F.try_element_at("w", F.lit(i)), F.lit(""))
    more = F.concat(F.lit('"Secondary_Verbs": ["'), F.array_join(F.slice("w", 2, 3), '", " '), F.lit('"], '))
    reply = F.concat(F.lit("so: {"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit('"primary_verb" : " '), F.upper(at(1)), F.lit(' ", '))), F.when(n % 3 == 0, "").otherwise(more), F.when(n % 6 == 0, "").otherwise(F.concat(F.lit('"object": "'), at(5), F.lit('"'))), F.lit("}"))
    rows = table(spark, d, "conversations").withColumn("w", w)
    told = fields.reply_fields(ONTO, reply, F.col("text"))
    verbs = told["verbs"]
    return rows.select("conv_id", "turn", F.when(F.size(verbs) > 0, F.array_join(verbs, ",")).alias("verbs"), told["object"].alias("object"))


POLICY = f"q AS (SELECT doc_id, lang, s - s2 AS off, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN z = 1 THEN 'poor' ELSE 'clear' END AS view, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE s2 END AS camera, CASE WHEN s >= s2 AND s >= 0.45 THEN 'POINT' WHEN s2 >= 0.45 THEN 'NONE' ELSE 'GRADUAL' END AS m, greatest(s, s2, 0.45) AS pm, CASE WHEN y = 1 THEN 'EXACT' WHEN doc_id % 2 = 0 THEN 'EARLY' ELSE 'LATE' END AS r, CASE WHEN y = 1 THEN 0.8 WHEN doc_id % 2 = 0 THEN 0.45 ELSE 0.35 END AS pr FROM scored), b AS (SELECT *, CASE WHEN m = 'GRADUAL' THEN 'never_automatic' WHEN lang = 'es' THEN 'subtype_never_automatic' WHEN view IS NULL THEN 'view_missing' WHEN view <> 'clear' THEN 'view_blocks' WHEN camera IS NULL THEN 'camera_missing' WHEN camera >= 0.7 THEN 'camera_blocks' END AS blocked_by FROM q)"


@book.add("r13_whole_policy", f"WITH {SCORED}, {POLICY} SELECT doc_id, CASE WHEN blocked_by IS NOT NULL THEN 'REVIEW' WHEN {FITS['AUTO_KEEP']} THEN 'AUTO_KEEP' WHEN {FITS['SUGGEST_RETIME']} THEN 'REVIEW' WHEN {FITS['AUTO_REJECT']} THEN 'AUTO_REJECT' ELSE 'REVIEW' END AS action, CASE WHEN blocked_by IS NULL AND NOT ({FITS['AUTO_KEEP']}) AND {FITS['SUGGEST_RETIME']} THEN 'SUGGEST_RETIME' END AS blocked_action, blocked_by FROM b")
def r13(spark, d):
    """The policy with subtypes that are never automatic and the camera's motion as a nuisance."""
    s, s2, y = F.col("s"), F.col("s2"), F.col("y")
    even = F.col("doc_id") % 2 == 0
    q = scored(spark, d).select("doc_id", F.col("lang").alias("subtype"), (s - s2).alias("offset"), F.when(F.col("doc_id") % 17 != 0, F.when(F.col("z") == 1, "poor").otherwise("clear")).alias("view"), F.when(F.col("doc_id") % 19 != 0, s2).alias("camera"), F.create_map(F.lit("POINT"), s, F.lit("NONE"), s2, F.lit("GRADUAL"), F.lit(0.45)).alias("morphology"), F.create_map(F.lit("EXACT"), F.when(y == 1, 0.8).otherwise(0.1), F.lit("EARLY"), F.when((y != 1) & even, 0.45).otherwise(0.05), F.lit("LATE"), F.when((y != 1) & ~even, 0.35).otherwise(0.05)).alias("relation"))
    orders = {"morphology": ["POINT", "NONE", "GRADUAL"], "relation": ["EXACT", "EARLY", "LATE"]}
    out = rules.ontology_action(orders, ["GRADUAL"], {"view": ["clear"]}, ACTIONS, ["es"], {"camera": 0.7})
    return q.select("doc_id", *[c.alias(n) for n, c in out.items()])


@book.add(
    "v23_stop_start_features",
    """WITH f AS (SELECT l_suppkey AS rec, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS x, l_discount AS a FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)),
  b AS (SELECT *, (i - n // 2) * 0.1 AS rel, x + 5 AS cx, x / 2 + 5 + x / 8 AS cy, sqrt(100 + (10 + x / 4) * (10 + x / 4)) AS dg FROM f),
  c AS (SELECT *, quantile_cont(dg, 0.5) OVER (PARTITION BY rec) AS sc, lag(cx) OVER o AS px, lead(cx) OVER o AS nx, lag(cy) OVER o AS py, lead(cy) OVER o AS ny FROM b WINDOW o AS (PARTITION BY rec ORDER BY i)),
  v AS (SELECT *, CASE WHEN cx IS NULL THEN NULL WHEN i = 0 THEN sqrt(pow(nx - cx, 2) + pow(ny - cy, 2)) WHEN i = n - 1 THEN sqrt(pow(cx - px, 2) + pow(cy - py, 2)) ELSE sqrt(pow((nx - px) / 2, 2) + pow((ny - py) / 2, 2)) END / 0.1 / sc AS v FROM c),
  m AS (SELECT rec, quantile_cont(v, 0.5) AS md, count(dg) AS boxes FROM v GROUP BY rec),
  g AS (SELECT rec, min(md) AS md, min(boxes) AS boxes, min(v) FILTER (WHERE abs(rel) <= 0.5001) AS low, count(*) FILTER (WHERE abs(rel) <= 0.5001 AND v < 0.25 * md) AS still, avg(v) FILTER (WHERE rel < -0.25005) AS pre, avg(v) FILTER (WHERE rel > 0.25005) AS post, quantile_cont(dg, 0.5) FILTER (WHERE rel < -0.25005 AND v IS NOT NULL) AS d0, quantile_cont(dg, 0.5) FILTER (WHERE rel > 0.25005 AND v IS NOT NULL) AS d1, quantile_cont(a, 0.5) FILTER (WHERE i < n // 2) AS a0, quantile_cont(a, 0.5) FILTER (WHERE i >= n // 2) AS a1 FROM v JOIN m USING (rec) GROUP BY rec)
  SELECT rec, round(low, 6) AS least_speed, round(still * CAST(0.1 AS DOUBLE), 6) AS stopped_for, round((pre + post) / 2 / greatest(low, 1e-6) / greatest(md, 1e-6), 3) AS score, round(abs(d1 - d0) / greatest(d0, 1e-6), 6) AS size_change, round(abs(a1 - a0), 6) AS turn FROM g WHERE boxes >= 6""",
)
def v23(spark, d):
    """Stop-start features around the middle of each supplier's frames; some frames have no box."""
    w = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    x = F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("rec"), (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy("l_suppkey")).alias("n"), x.alias("x0"), (x / 2).alias("y0"), (x + 10).alias("x1"), (x / 2 + 10 + x / 4).alias("y1"), F.col("l_discount").alias("angle"))
    frames = rows.withColumn("rel", (F.col("i") - F.floor(F.col("n") / 2)) * 0.1)
    out = motion.stop_start(frames, ["rec"], "i", "rel", 0.1, "angle", near=0.5001, floors=True)
    places = {"score": 3}
    return out.select("rec", *[F.round(c, places.get(c, 6)).alias(c) for c in ("least_speed", "stopped_for", "score", "size_change", "turn")])
