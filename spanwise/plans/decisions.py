"""Queries on rules, policies, reconciliation, filters and sampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..operators import matching, reconcile, rules, sampling
from ..operators.lineage import settled
from ..session import table
from .base import CURVE, SCORED, Book, curve, r6, scored

book = Book()
WITH = f"WITH {SCORED}"


def rows_count():
    """The number of rows, as an aggregate; made when asked for, as columns need a session."""
    return F.count(F.lit(1))


REASONS = {"low_score": "s < 0.3", "second_low": "s2 < 0.2", "toxic": "z = 1", "odd_language": "lang NOT IN ('en', 'de', 'fr')"}
CASE = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in REASONS.items()) + " END"
LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in REASONS.items()) + "], lambda x: x IS NOT NULL)"
RULES = [(k, c) for k, c in REASONS.items()]


def compiled():
    return [(k, F.expr(c)) for k, c in RULES]


@book.add("p01_taxonomy_filter", f"{WITH}, p AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN lang = 'es' THEN 'context' WHEN y = 1 THEN 'positive' ELSE 'negative' END AS supervision FROM scored) SELECT coalesce(supervision, '<unlabelled>') AS reason, supervision IN ('positive', 'negative') IS TRUE AS kept, count(*) AS n, CAST(sum(CASE WHEN supervision = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM p GROUP BY 1, 2")
def p01(spark, d):
    s = F.when(F.col("doc_id") % 9 == 0, None).when(F.col("lang") == "es", "context").when(F.col("y") == 1, "positive").otherwise("negative")
    p = scored(spark, d).withColumn("supervision", s)
    kept = F.coalesce(F.col("supervision").isin("positive", "negative"), F.lit(False))
    return p.groupBy(F.coalesce("supervision", F.lit("<unlabelled>")).alias("reason"), kept.alias("kept")).agg(rows_count().alias("n"), F.count_if(F.coalesce(F.col("supervision") == "positive", F.lit(False))).alias("positives"))


@book.add("p02_decisive_events", f"WITH {CURVE}, e AS (SELECT i, user_id, CASE WHEN i % 2 = 0 THEN t END AS pred_time, CASE WHEN i % 5 <> 0 THEN t + 1 END AS gt_time, label FROM curve) SELECT i, user_id, coalesce(pred_time, gt_time) AS time FROM e WHERE label IN ('view', 'error') AND coalesce(pred_time, gt_time) IS NOT NULL")
def p02(spark, d):
    e = curve(spark, d).withColumn("pred", F.when(F.col("i") % 2 == 0, F.col("t"))).withColumn("gt", F.when(F.col("i") % 5 != 0, F.col("t") + 1))
    return e.where(F.col("label").isin("view", "error")).select("i", "user_id", F.coalesce("pred", "gt").alias("time")).where("time IS NOT NULL")


@book.add("p03_first_blocking_reason", f"{WITH} SELECT doc_id, {CASE} AS reason FROM scored")
def p03(spark, d):
    return scored(spark, d).select("doc_id", rules.first_reason(compiled()).alias("reason"))


@book.add("p04_all_failing_reasons", f"{WITH} SELECT doc_id, {LIST} AS reasons, len({LIST}) = 0 AS safe FROM scored")
def p04(spark, d):
    reasons = rules.all_reasons(compiled())
    return scored(spark, d).select("doc_id", reasons.alias("reasons"), (F.size(reasons) == 0).alias("safe"))


ANSWERS = f"{WITH}, ans AS (SELECT doc_id, y, CASE WHEN s > 0.6 THEN 'yes' WHEN s > 0.2 THEN 'no' END AS a, CASE WHEN s2 > 0.5 THEN 'yes' WHEN s2 > 0.4 THEN 'insufficient' ELSE 'no' END AS b FROM scored)"


def answers(spark, d):
    a = F.when(F.col("s") > 0.6, "yes").when(F.col("s") > 0.2, "no")
    b = F.when(F.col("s2") > 0.5, "yes").when(F.col("s2") > 0.4, "insufficient").otherwise("no")
    return scored(spark, d).select("doc_id", "y", a.alias("a"), b.alias("b"))


@book.add("p05_config_checks", f"{ANSWERS} SELECT doc_id, list_filter([CASE WHEN coalesce(a = 'yes', false) = false THEN 'require_yes:a' END, CASE WHEN b = 'no' THEN 'forbid_no:b' END, CASE WHEN a IS NULL OR a = 'insufficient' THEN 'forbid_insufficient:a' END, CASE WHEN b = 'insufficient' THEN 'forbid_insufficient:b' END], lambda x: x IS NOT NULL) AS fails FROM ans")
def p05(spark, d):
    config = {"require_yes": ["a"], "forbid_no": ["b"], "forbid_insufficient": ["a", "b"]}
    return answers(spark, d).select("doc_id", rules.all_reasons(rules.checks(config, ["a", "b"])).alias("fails"))


@book.add("p06_contradiction", f"{ANSWERS} SELECT doc_id FROM ans WHERE y = 1 AND a = 'no' AND b = 'no'")
def p06(spark, d):
    return answers(spark, d).where("y = 1 AND a = 'no' AND b = 'no'").select("doc_id")


@book.add("p07_closed_vocabulary", "SELECT c_custkey, CASE WHEN lower(trim(c_mktsegment)) IN ('building', 'machinery', 'household') THEN lower(trim(c_mktsegment)) END AS segment FROM customer")
def p07(spark, d):
    return table(spark, d, "customer").select("c_custkey", rules.normalised(F.col("c_mktsegment"), ["building", "machinery", "household"]).alias("segment"))


@book.add("p08_buckets", "SELECT CASE WHEN n_chars < 300 THEN '<300' WHEN n_chars < 800 THEN '<800' WHEN n_chars < 1500 THEN '<1500' ELSE '1500+' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def p08(spark, d):
    return table(spark, d, "documents").groupBy(sc.bucket(F.col("n_chars"), [300, 800, 1500], ["<300", "<800", "<1500", "1500+"]).alias("bucket")).agg(rows_count().alias("n"))


@book.add("p09_stratum_key", "SELECT lang || '|' || source || '|' || CASE WHEN n_chars < 800 THEN 'short' ELSE 'long' END AS stratum, count(*) AS n FROM documents GROUP BY 1")
def p09(spark, d):
    return table(spark, d, "documents").groupBy(F.concat_ws("|", "lang", "source", F.when(F.col("n_chars") < 800, "short").otherwise("long")).alias("stratum")).agg(rows_count().alias("n"))


KEYS = f"WITH {CURVE}, k AS (SELECT i, 'recording_' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '_' || label || '_t' || CAST(i * 0.5 AS DECIMAL(12, 1)) AS event_key FROM curve)"


@book.add("p10_event_key_parse", f"{KEYS} SELECT i, CAST(regexp_extract(event_key, '^recording_([0-9]+)_', 1) AS BIGINT) AS recording, regexp_extract(event_key, '^recording_[0-9]+_(.+)_t[0-9.]+$', 1) AS category, CAST(regexp_extract(event_key, '_t([0-9.]+)$', 1) AS DOUBLE) AS time FROM k")
def p10(spark, d):
    key = F.concat(F.lit("recording_"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("_"), "label", F.lit("_t"), (F.col("i") * 0.5).cast("decimal(12,1)").cast("string"))
    k = curve(spark, d).select("i", key.alias("event_key"))
    get = lambda p: F.regexp_extract("event_key", p, 1)
    return k.select("i", get("^recording_([0-9]+)_").cast("long").alias("recording"), get("^recording_[0-9]+_(.+)_t[0-9.]+$").alias("category"), get("_t([0-9.]+)$").cast("double").alias("time"))


@book.add("p11_first_key", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS v FROM events")
def p11(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k")).alias("v"))


@book.add("p12_keyword_tagger", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' WHEN regexp_matches(text, '@') THEN 'contact' WHEN regexp_matches(text, '[|]') THEN 'table' END AS tag FROM documents")
def p12(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", rules.first_reason([("license", t.rlike("(?i)license")), ("contact", t.rlike("@")), ("table", t.rlike("[|]"))]).alias("tag"))


@book.add("p13_frame_classes", f"WITH {CURVE}, n AS (SELECT *, lag(prob) OVER w AS b, lead(prob) OVER w AS a FROM curve WINDOW w AS (PARTITION BY user_id ORDER BY t, i)) SELECT i, CASE WHEN prob < 5 THEN 'black' WHEN prob < 15 THEN 'blur' WHEN abs(prob - b) < 1 THEN 'static' ELSE 'normal' END AS class, coalesce(prob > b, true) AND coalesce(prob > a, true) AND prob > 60 AS key FROM n")
def p13(spark, d):
    w = W.partitionBy("user_id").orderBy("t", "i")
    n = curve(spark, d).withColumn("b", F.lag("prob").over(w)).withColumn("a", F.lead("prob").over(w))
    p = F.col("prob")
    kind = F.when(p < 5, "black").when(p < 15, "blur").when(F.abs(p - F.col("b")) < 1, "static").otherwise("normal")
    return n.select("i", kind.alias("class"), (F.coalesce(p > F.col("b"), F.lit(True)) & F.coalesce(p > F.col("a"), F.lit(True)) & (p > 60)).alias("key"))


@book.add("p16_feature_eligibility", "WITH f AS (SELECT 'value' AS feature, value AS v FROM events UNION ALL SELECT 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events UNION ALL SELECT 'none', NULL FROM events) SELECT feature, count(v) AS n, count(DISTINCT v) AS kinds, CASE WHEN count(v) < 30 THEN 'too_few' WHEN count(DISTINCT v) < 5 THEN 'too_uniform' END AS reason FROM f GROUP BY feature")
def p16(spark, d):
    e = table(spark, d, "events").select("value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.lit(None).cast("double").alias("none"))
    f = e.unpivot([], ["value", "k", "none"], "feature", "v").groupBy("feature").agg(F.count("v").alias("n"), F.count_distinct("v").alias("kinds"))
    return f.withColumn("reason", F.when(F.col("n") < 30, "too_few").when(F.col("kinds") < 5, "too_uniform"))


@book.add("r01_boundary_fields", f"{WITH} SELECT doc_id, CASE WHEN lang = 'en' AND y = 1 THEN 'aligned' WHEN lang = 'en' THEN 'missed' WHEN y = 1 THEN 'matched' ELSE 'unmatched' END AS relation, CASE WHEN s < 0.15 THEN 'weak' WHEN y = 1 THEN 'fires' ELSE 'spurious' END AS behaviour FROM scored")
def r01(spark, d):
    anchored, good = F.col("lang") == "en", F.col("y") == 1
    relation = F.when(anchored & good, "aligned").when(anchored, "missed").when(good, "matched").otherwise("unmatched")
    return scored(spark, d).select("doc_id", relation.alias("relation"), F.when(F.col("s") < 0.15, "weak").when(good, "fires").otherwise("spurious").alias("behaviour"))


VOTES = "[CASE WHEN s >= 0.5 THEN 'a' ELSE 'b' END, CASE WHEN s2 >= 0.5 THEN 'a' END, CASE WHEN y = 1 THEN 'a' ELSE 'c' END]"


@book.add("r04_consensus_confidence", f"{WITH}, v AS (SELECT doc_id, list_filter({VOTES}, lambda x: x IS NOT NULL) AS v FROM scored), c AS (SELECT doc_id, v, list_sort(list_transform(list_distinct(v), lambda x: {{'n': -len(list_filter(v, lambda q: q = x)), 'at': list_position(v, x), 'v': x}}))[1] AS b FROM v) SELECT doc_id, b.v AS vote, CASE WHEN -b.n / 3.0 >= 0.8 THEN 'high' WHEN -b.n / 3.0 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM c")
def r04(spark, d):
    votes = F.array(F.when(F.col("s") >= 0.5, "a").otherwise("b"), F.when(F.col("s2") >= 0.5, "a"), F.when(F.col("y") == 1, "a").otherwise("c"))
    vote, share = rules.consensus(votes)
    return scored(spark, d).select("doc_id", vote.alias("vote"), sc.bucket(share, [0.5, 0.8], ["low", "medium", "high"]).alias("confidence"))


@book.add("r06_candidate_relation", f"{WITH}, o AS (SELECT doc_id, y, z, round(s - s2, 6) * 4 AS o FROM scored) SELECT doc_id, CASE WHEN z = 1 THEN 'UNDECIDABLE' WHEN y = 0 THEN 'NO_VALID' WHEN abs(o) <= 0.5 THEN 'EXACT' WHEN abs(o) > 2 THEN 'NO_VALID' WHEN o < 0 THEN 'EARLY' ELSE 'LATE' END AS relation, CASE WHEN z = 0 AND y = 1 AND abs(o) <= 2 THEN round(o, 6) END AS \"offset\" FROM o")
def r06(spark, d):
    o = F.col("o")
    rows = scored(spark, d).withColumn("o", r6(F.col("s") - F.col("s2")) * 4)
    relation = F.when(F.col("z") == 1, "UNDECIDABLE").when(F.col("y") == 0, "NO_VALID").when(F.abs(o) <= 0.5, "EXACT").when(F.abs(o) > 2, "NO_VALID").when(o < 0, "EARLY").otherwise("LATE")
    return rows.select("doc_id", relation.alias("relation"), F.when((F.col("z") == 0) & (F.col("y") == 1) & (F.abs(o) <= 2), r6(o)).alias("offset"))


POLICIES = "policies AS (SELECT family, CAST(k AS DOUBLE) AS keep, CAST(r AS DOUBLE) AS reject FROM (SELECT unnest(['threshold', 'fused', 'agreement', 'cascade']) AS family) a, (SELECT unnest([0.5, 0.7, 0.9]) AS k) b, (SELECT unnest([0.1, 0.3, 0.6]) AS r) c WHERE k > r)"
BY = "CASE WHEN {0} >= keep THEN 'KEEP' WHEN {0} <= reject THEN 'REJECT' END"
DECIDED = f"{WITH}, {POLICIES}, x AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE s END AS sa, abs(s - s2) AS gap FROM scored), dec AS (SELECT family, keep, reject, y, z, doc_id, CASE WHEN coalesce(1 - gap < 0.2, true) THEN 'REVIEW:unreliable' WHEN sa IS NULL THEN 'REVIEW:missing_score' ELSE coalesce(CASE family WHEN 'threshold' THEN {BY.format('sa')} WHEN 'fused' THEN {BY.format('((sa + s2) / 2)')} WHEN 'agreement' THEN CASE WHEN ({BY.format('sa')}) IS NOT DISTINCT FROM ({BY.format('s2')}) THEN {BY.format('sa')} END WHEN 'cascade' THEN coalesce({BY.format('sa')}, {BY.format('s2')}) END, 'REVIEW:undecided') END AS decision FROM x, policies)"


def policies(spark):
    # a stated grid of parameters: four families, three by three thresholds
    grid = [(f, k, r) for f in ("threshold", "fused", "agreement", "cascade") for k in (0.5, 0.7, 0.9) for r in (0.1, 0.3, 0.6) if k > r]
    return spark.createDataFrame(grid, "family string, keep double, reject double")


def decisions(spark, d):
    rows = scored(spark, d).withColumn("sa", F.when(F.col("doc_id") % 17 != 0, F.col("s"))).withColumn("rel", 1 - F.abs(F.col("s") - F.col("s2")))
    each = rows.join(F.broadcast(policies(spark)))
    c = F.col
    return each.withColumn("decision", rules.decide(c("family"), c("sa"), c("s2"), c("rel"), c("keep"), c("reject"), F.lit(0.2)))


@book.add("u06_policy_grid", f"WITH {POLICIES} SELECT family, keep, reject FROM policies")
def u06(spark, d):
    return policies(spark)


@book.add("r07_selective_decisions", f"{DECIDED} SELECT family, keep, reject, decision, count(*) AS n FROM dec GROUP BY ALL")
def r07(spark, d):
    return decisions(spark, d).groupBy("family", "keep", "reject", "decision").agg(rows_count().alias("n"))


METRICS = f"{DECIDED}, met AS (SELECT family, keep, reject, count(*) FILTER (WHERE decision = 'KEEP') AS kept, count(*) FILTER (WHERE decision = 'KEEP' AND y = 0) AS wrong, count(*) FILTER (WHERE decision IN ('KEEP', 'REJECT')) AS auto, count(*) AS n FROM dec GROUP BY family, keep, reject)"


def policy_metrics(spark, d):
    keep = F.col("decision") == "KEEP"
    return decisions(spark, d).groupBy("family", "keep", "reject").agg(F.count_if(keep).alias("kept"), F.count_if(keep & (F.col("y") == 0)).alias("wrong"), F.count_if(F.col("decision").isin("KEEP", "REJECT")).alias("auto"), rows_count().alias("n"))


@book.add("r08_policy_constraints", f"{METRICS} SELECT family, keep, reject, kept >= 10 AND wrong <= floor(kept * (1 - CAST(0.85 AS DOUBLE))) AS frontier, kept >= 10 AND wrong + 1 <= floor(kept * (1 - CAST(0.85 AS DOUBLE))) AS buffered FROM met")
def r08(spark, d):
    room = F.floor(F.col("kept") * (1 - F.lit(0.85)))
    many = F.col("kept") >= 10
    return policy_metrics(spark, d).select("family", "keep", "reject", (many & (F.col("wrong") <= room)).alias("frontier"), (many & (F.col("wrong") + 1 <= room)).alias("buffered"))


@book.add("r09_policy_selection", f"{METRICS} SELECT family, keep, reject, kept, wrong FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN kept >= 10 AND wrong <= floor(kept * (1 - CAST(0.85 AS DOUBLE))) THEN 0 ELSE 1 END, auto DESC, wrong / CAST(greatest(kept, 1) AS DOUBLE), family, keep, reject) AS r FROM met) q WHERE r = 1")
def r09(spark, d):
    ok = (F.col("kept") >= 10) & (F.col("wrong") <= F.floor(F.col("kept") * (1 - F.lit(0.85))))
    order = [F.when(ok, 0).otherwise(1), F.col("auto").desc(), F.col("wrong") / F.greatest(F.col("kept"), F.lit(1)), "family", "keep", "reject"]
    return policy_metrics(spark, d).orderBy(*order).limit(1).select("family", "keep", "reject", "kept", "wrong")


@book.add("r10_nested_selection", f"{DECIDED}, fm AS (SELECT f.fold, family, keep, reject, count(*) FILTER (WHERE doc_id % 5 <> f.fold AND decision = 'KEEP') AS kept, count(*) FILTER (WHERE doc_id % 5 <> f.fold AND decision = 'KEEP' AND y = 0) AS wrong, count(*) FILTER (WHERE doc_id % 5 = f.fold AND decision = 'KEEP') AS held, count(*) FILTER (WHERE doc_id % 5 = f.fold AND decision = 'KEEP' AND y = 1) AS held_right FROM dec, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f GROUP BY f.fold, family, keep, reject), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN kept >= 10 AND wrong <= floor(kept * (1 - CAST(0.85 AS DOUBLE))) THEN 0 ELSE 1 END, kept DESC, family, keep, reject) AS k FROM fm) SELECT CAST(fold AS INTEGER) AS fold, family, keep, reject, held, held_right FROM r WHERE k = 1")
def r10(spark, d):
    mine = decisions(spark, d).withColumn("own", (F.col("doc_id") % 5).cast("int"))
    keep, good = F.col("decision") == "KEEP", F.col("y") == 1
    # sums by fold first; a fold's training sums are all folds' less its own
    by = mine.groupBy("own", "family", "keep", "reject").agg(F.count_if(keep).alias("k"), F.count_if(keep & ~good).alias("w"), F.count_if(keep & good).alias("g"))
    w = W.partitionBy("family", "keep", "reject")
    t = by.withColumn("kept", F.sum("k").over(w) - F.col("k")).withColumn("wrong", F.sum("w").over(w) - F.col("w"))
    ok = (F.col("kept") >= 10) & (F.col("wrong") <= F.floor(F.col("kept") * (1 - F.lit(0.85))))
    r = F.row_number().over(W.partitionBy("own").orderBy(F.when(ok, 0).otherwise(1), F.col("kept").desc(), "family", "keep", "reject"))
    return t.withColumn("r", r).where("r = 1").select(F.col("own").alias("fold"), "family", "keep", "reject", F.col("k").alias("held"), F.col("g").alias("held_right"))


@book.add("r11_routing", f"{WITH} SELECT doc_id, CASE WHEN z = 1 THEN 'REVIEW:veto' WHEN lang = 'es' THEN 'REVIEW:no_threshold' WHEN source = 'src1' THEN 'REVIEW:uncertified' WHEN doc_id % 17 = 0 THEN 'REVIEW:no_score' WHEN s < 0.4 THEN 'REVIEW:below' ELSE 'AUTO' END AS action FROM scored")
def r11(spark, d):
    c = F.col
    threshold = F.when(c("lang") != "es", F.lit(0.4))
    score = F.when(c("doc_id") % 17 != 0, c("s"))
    return scored(spark, d).select("doc_id", rules.route(c("z") == 1, threshold, c("source") != "src1", score).alias("action"))


@book.add("r12_structural_veto", f"{WITH}, p AS (SELECT doc_id, s AS a, s2 AS b, 1 - s AS c FROM scored) SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'sharp' WHEN b >= c THEN 'same' ELSE 'cannot' END AS class, NOT (a >= b AND a >= c) AS veto FROM p")
def r12(spark, d):
    p = scored(spark, d).select("doc_id", F.create_map(F.lit("sharp"), F.col("s"), F.lit("same"), F.col("s2"), F.lit("cannot"), 1 - F.col("s")).alias("m"))
    entries = F.transform(F.map_entries("m"), lambda e: F.struct((-e["value"]).alias("v"), F.array_position(F.array(F.lit("sharp"), F.lit("same"), F.lit("cannot")), e["key"]).alias("at"), e["key"].alias("k")))
    best = F.array_min(entries)["k"]
    return p.select("doc_id", best.alias("class"), (best != "sharp").alias("veto"))


@book.add("r14_joint_policy", f"{WITH} SELECT doc_id, CASE WHEN z = 1 THEN 'REVIEW' WHEN s >= 0.7 AND s2 >= 0.3 THEN 'BOUNDARY' WHEN s < 0.3 AND s2 < 0.3 AND y = 0 THEN 'AUTO_REJECT' ELSE 'REVIEW' END AS action, list_filter([CASE WHEN z = 1 THEN 'hard_rule' END, CASE WHEN NOT (s < 0.3) THEN 'score_not_low' END, CASE WHEN NOT (s2 < 0.3) THEN 'no_cross_support' END], lambda x: x IS NOT NULL) AS blocked_by FROM scored")
def r14(spark, d):
    s, s2, y, z = (F.col(k) for k in ("s", "s2", "y", "z"))
    action = F.when(z == 1, "REVIEW").when((s >= 0.7) & (s2 >= 0.3), "BOUNDARY").when((s < 0.3) & (s2 < 0.3) & (y == 0), "AUTO_REJECT").otherwise("REVIEW")
    return scored(spark, d).select("doc_id", action.alias("action"), rules.all_reasons([("hard_rule", z == 1), ("score_not_low", ~(s < 0.3)), ("no_cross_support", ~(s2 < 0.3))]).alias("blocked_by"))


@book.add("r15_gate_check", f"{WITH}, g AS (SELECT source, avg(CAST(y AS DOUBLE)) AS v, count(*) AS n, CASE WHEN source IN ('src3', 'src4') THEN NULL ELSE CAST(0.85 AS DOUBLE) END AS target FROM scored GROUP BY source) SELECT source, CASE WHEN target IS NULL THEN 'no_target' WHEN v IS NULL THEN 'no_value' WHEN n < 15 THEN 'too_few' WHEN v < target THEN 'below_target' END AS failure FROM g")
def r15(spark, d):
    g = scored(spark, d).groupBy("source").agg(F.avg("y").alias("v"), rows_count().alias("n")).withColumn("target", F.when(~F.col("source").isin("src3", "src4"), F.lit(0.85)))
    return g.select("source", rules.gate(F.col("v"), F.col("target"), F.col("n"), 15).alias("failure"))


@book.add("r16_certificate_overlap", f"{WITH} SELECT count(*) AS overlap, count(*) = 0 AS valid FROM (SELECT doc_id FROM scored WHERE doc_id % 6 = 0 INTERSECT SELECT doc_id FROM scored WHERE doc_id % 10 = 1) q")
def r16(spark, d):
    ids = scored(spark, d).select("doc_id")
    return ids.where("doc_id % 6 = 0").intersect(ids.where("doc_id % 10 = 1")).agg(rows_count().alias("overlap"), (rows_count() == 0).alias("valid"))


@book.add("r17_standard_crosstab", f"{WITH} SELECT CASE WHEN s >= 0.5 THEN 'yes' ELSE 'no' END AS old, CASE WHEN s >= 0.6 THEN 'yes' WHEN s >= 0.4 THEN 'maybe' ELSE 'no' END AS new, count(*) AS n FROM scored GROUP BY 1, 2")
def r17(spark, d):
    s = F.col("s")
    return scored(spark, d).groupBy(F.when(s >= 0.5, "yes").otherwise("no").alias("old"), F.when(s >= 0.6, "yes").when(s >= 0.4, "maybe").otherwise("no").alias("new")).agg(rows_count().alias("n"))


@book.add("r18_heldout_verdict", f"{WITH}, p AS (SELECT lang, count(*) AS n, avg(CAST(y AS DOUBLE)) AS p FROM scored WHERE s >= 0.4 GROUP BY lang) SELECT lang, CASE WHEN p >= 0.9 THEN 'A' WHEN p >= 0.8 THEN 'B' ELSE 'C' END AS verdict FROM p")
def r18(spark, d):
    p = scored(spark, d).where("s >= 0.4").groupBy("lang").agg(F.avg("y").alias("p"))
    return p.select("lang", F.when(F.col("p") >= 0.9, "A").when(F.col("p") >= 0.8, "B").otherwise("C").alias("verdict"))


@book.add("r20_linear_scoring", f"{WITH} SELECT doc_id, round((coalesce(CASE WHEN doc_id % 17 <> 0 THEN s END, 0.5) - 0.5) / 0.25 * 1.5, 6) AS contribution_s, round((s2 - 0.4) / 0.3 * -0.7, 6) AS contribution_s2, round(1 / (1 + exp(-((coalesce(CASE WHEN doc_id % 17 <> 0 THEN s END, 0.5) - 0.5) / 0.25 * 1.5 + (s2 - 0.4) / 0.3 * -0.7 + 0.2))), 6) AS prob FROM scored")
def r20(spark, d):
    a = (F.coalesce(F.when(F.col("doc_id") % 17 != 0, F.col("s")), F.lit(0.5)) - 0.5) / 0.25 * 1.5
    b = (F.col("s2") - 0.4) / 0.3 * -0.7
    return scored(spark, d).select("doc_id", r6(a).alias("contribution_s"), r6(b).alias("contribution_s2"), r6(sc.sigmoid(a + b + 0.2)).alias("prob"))


@book.add("r21_notes_to_tri_state", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(no|not|nicht|pas)([^a-z]|$)') THEN 'OBSERVED_ABSENT' WHEN regexp_matches(lower(text), '(^|[^a-z])(is|the|die|le)([^a-z]|$)') THEN 'OBSERVED_PRESENT' ELSE 'NOT_OBSERVABLE' END AS state FROM documents")
def r21(spark, d):
    t = F.lower("text")
    return table(spark, d, "documents").select("doc_id", F.coalesce(rules.first_reason([("OBSERVED_ABSENT", t.rlike("(^|[^a-z])(no|not|nicht|pas)([^a-z]|$)")), ("OBSERVED_PRESENT", t.rlike("(^|[^a-z])(is|the|die|le)([^a-z]|$)"))]), F.lit("NOT_OBSERVABLE")).alias("state"))


@book.add("r24_repeat_stability", f"WITH {CURVE} SELECT user_id, count(*) AS draws, CASE WHEN count(*) FILTER (WHERE prob >= 20) = count(*) THEN 'all' WHEN count(*) FILTER (WHERE prob >= 20) = 0 THEN 'none' ELSE 'some' END AS stability FROM curve WHERE label = 'purchase' GROUP BY user_id")
def r24(spark, d):
    hit = F.count_if(F.col("prob") >= 20)
    return curve(spark, d).where("label = 'purchase'").groupBy("user_id").agg(rows_count().alias("draws"), F.when(hit == rows_count(), "all").when(hit == 0, "none").otherwise("some").alias("stability"))


CLAIMS = f"claims AS (SELECT doc_id, 1 AS rank, CASE WHEN doc_id % 3 = 0 THEN 'UNKNOWN' WHEN y = 1 THEN 'good' ELSE 'bad' END AS v FROM scored UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN s >= 0.5 THEN 'good' ELSE 'bad' END FROM scored UNION ALL SELECT doc_id, 3, CASE WHEN z = 1 THEN 'bad' ELSE 'UNKNOWN' END FROM scored)"


def claims(spark, d):
    rows = scored(spark, d)
    good = lambda c: F.when(c, "good").otherwise("bad")
    sources = [F.when(F.col("doc_id") % 3 == 0, "UNKNOWN").otherwise(good(F.col("y") == 1)), F.when(F.col("doc_id") % 4 != 0, good(F.col("s") >= 0.5)), F.when(F.col("z") == 1, "bad").otherwise("UNKNOWN")]
    return rows.select("doc_id", F.posexplode(F.array(*sources)).alias("rank", "v"))


@book.add("u04_claim_resolution", f"{WITH}, {CLAIMS} SELECT doc_id, arg_max(v, rank) FILTER (WHERE v IS NOT NULL AND v <> 'UNKNOWN') AS resolved, count(*) FILTER (WHERE v IS NOT NULL AND v <> 'UNKNOWN') AS claims, count(DISTINCT CASE WHEN v <> 'UNKNOWN' THEN v END) > 1 AS conflict FROM claims GROUP BY doc_id")
def u04(spark, d):
    return reconcile.resolve(claims(spark, d), ["doc_id"], "rank", "v")


@book.add("u01_union_first_wins", "WITH u AS (SELECT doc_id, lang, 1 AS r FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, upper(lang), 2 FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS k FROM u) q WHERE k = 1")
def u01(spark, d):
    docs = table(spark, d, "documents")
    u = docs.where("doc_id % 2 = 0").select("doc_id", "lang", F.lit(1).alias("r")).unionByName(docs.where("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang"), F.lit(2).alias("r")))
    return reconcile.first_wins(u, "doc_id", "r").select("doc_id", "lang")


@book.add("u02_shared_keys", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM labels")
def u02(spark, d):
    return table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@book.add("u03_symmetric_difference", f"{WITH}, a AS (SELECT lang, y FROM scored WHERE s >= 0.4), b AS (SELECT lang, y FROM scored WHERE s2 >= 0.4) SELECT side, lang, y, count(*) AS n FROM (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) p UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) q) r GROUP BY ALL")
def u03(spark, d):
    rows = scored(spark, d)
    return reconcile.symmetric_difference(rows.where("s >= 0.4").select("lang", "y"), rows.where("s2 >= 0.4").select("lang", "y")).groupBy("side", "lang", "y").agg(rows_count().alias("n"))


@book.add("u05_unanimous_upsert", f"{WITH}, votes AS (SELECT doc_id, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS v FROM scored UNION ALL SELECT doc_id, CASE WHEN s2 >= 0.5 THEN 1 ELSE 0 END FROM scored), c AS (SELECT doc_id, min(v) AS v FROM votes GROUP BY doc_id HAVING min(v) = max(v) AND count(*) >= 2) SELECT doc_id, y AS before, coalesce(v, y) AS y, coalesce(v, y) <> y AS changed FROM scored LEFT JOIN c USING (doc_id)")
def u05(spark, d):
    rows = scored(spark, d)
    vote = lambda c: F.when(F.col(c) >= 0.5, 1).otherwise(0)
    votes = rows.select("doc_id", F.explode(F.array(vote("s"), vote("s2"))).alias("y"))
    return reconcile.upsert(rows, reconcile.unanimous(votes, "doc_id", "y", 2), "doc_id", "y").select("doc_id", "before", "y", "changed")


@book.add("u07_rule_overlap", "WITH v AS (SELECT unnest(['yes', 'no', 'unclear']) AS v), p AS (SELECT a.v AS a, b.v AS b, c.v AS c FROM v a, v b, v c), r AS (SELECT *, CAST(a = 'yes' AND b <> 'no' AS INTEGER) + CAST(a = 'no' AND c = 'yes' AS INTEGER) + CAST(b = 'no' AS INTEGER) AS n FROM p) SELECT n, count(*) AS combinations FROM r GROUP BY n")
def u07(spark, d):
    v = spark.createDataFrame([("yes",), ("no",), ("unclear",)], "v string")  # all 27 combinations of three answers
    p = v.select(F.col("v").alias("a")).crossJoin(v.select(F.col("v").alias("b"))).crossJoin(v.select(F.col("v").alias("c")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    n = ((a == "yes") & (b != "no")).cast("int") + ((a == "no") & (c == "yes")).cast("int") + (b == "no").cast("int")
    return p.groupBy(n.alias("n")).agg(rows_count().alias("combinations"))


@book.add("j01_gold_left_join", f"{WITH}, p AS (SELECT doc_id, s >= 0.5 AS h FROM scored WHERE doc_id % 4 <> 0) SELECT count(*) AS n, count(h) AS answered, round(avg(CASE WHEN h = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored LEFT JOIN p USING (doc_id)")
def j01(spark, d):
    rows = scored(spark, d)
    p = rows.where("doc_id % 4 <> 0").select("doc_id", (F.col("s") >= 0.5).alias("h"))
    right = F.coalesce(F.col("h") == (F.col("y") == 1), F.lit(False))
    return rows.join(p, "doc_id", "left").agg(rows_count().alias("n"), F.count("h").alias("answered"), r6(F.avg(right.cast("double"))).alias("accuracy"))


@book.add("j03_semi_join_both_classes", f"{WITH}, ok AS (SELECT source FROM scored GROUP BY source HAVING count(DISTINCT y) = 2) SELECT doc_id FROM scored WHERE source IN (SELECT source FROM ok)")
def j03(spark, d):
    rows = scored(spark, d)
    ok = rows.groupBy("source").agg(F.count_distinct("y").alias("k")).where("k = 2")
    return rows.join(ok, "source", "left_semi").select("doc_id")


@book.add("j04_anti_join_used", f"{WITH} SELECT doc_id FROM scored WHERE source NOT IN ('src1', 'src2', 'src7')")
def j04(spark, d):
    used = spark.createDataFrame([("src1",), ("src2",), ("src7",)], "source string")
    return reconcile.excluded(scored(spark, d), used, "source").select("doc_id")


@book.add("j20_matched_controls", f"{WITH}, p AS (SELECT a.doc_id, b.doc_id AS control, row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(a.s - b.s), abs(a.s2 - b.s2), b.doc_id) AS r FROM scored a JOIN scored b ON a.source = b.source AND a.lang = b.lang AND a.y = 0 AND b.y = 1) SELECT doc_id, control FROM p WHERE r = 1")
def j20(spark, d):
    rows = settled(scored(spark, d).select("doc_id", "source", "lang", "y", "s", "s2"))
    return matching.nearest_controls(rows.where("y = 0"), rows.where("y = 1").withColumnRenamed("doc_id", "control"), ["source", "lang"], "s", "s2", "doc_id", "control")


@book.add("j22_key_matched_pairs", f"{WITH}, r AS (SELECT doc_id, source, lang, y, row_number() OVER (PARTITION BY source, lang, y ORDER BY doc_id * 7919 % 1009, doc_id) AS k FROM scored) SELECT a.doc_id AS atomic, b.doc_id AS compound FROM r a JOIN r b ON a.source = b.source AND a.lang = b.lang AND a.k = b.k AND a.y = 1 AND b.y = 0 WHERE a.k <= 3")
def j22(spark, d):
    r = sampling.per_group(scored(spark, d).withColumn("k", F.row_number().over(W.partitionBy("source", "lang", "y").orderBy(sampling.draw("doc_id"), "doc_id"))), ["source", "lang", "y"], ["k"], 3)
    side = lambda y, name: r.where(F.col("y") == y).select("source", "lang", "k", F.col("doc_id").alias(name))
    return side(1, "atomic").join(side(0, "compound"), ["source", "lang", "k"]).select("atomic", "compound")


@book.add("j29_leakage_check", f"{WITH} SELECT count(*) AS leaked FROM (SELECT source FROM scored WHERE s < 0.5 INTERSECT SELECT source FROM scored WHERE s >= 0.5) q")
def j29(spark, d):
    rows = scored(spark, d)
    return rows.where("s < 0.5").select("source").intersect(rows.where("s >= 0.5").select("source")).agg(rows_count().alias("leaked"))


@book.add("s09_union_conflicts", "WITH u AS (SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END FROM documents) SELECT doc_id, count(DISTINCT lang) AS versions FROM u GROUP BY doc_id HAVING count(DISTINCT lang) > 1")
def s09(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return reconcile.conflicts(docs.unionByName(docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "xx").otherwise(F.col("lang")))), "doc_id", ["lang"])


@book.add("l02_most_common", f"{WITH} SELECT lang, count(*) AS n FROM scored GROUP BY lang ORDER BY n DESC, min(doc_id) LIMIT 3")
def l02(spark, d):
    return scored(spark, d).groupBy("lang").agg(rows_count().alias("n"), F.min("doc_id").alias("f")).orderBy(F.col("n").desc(), "f").limit(3).select("lang", "n")


@book.add("l03_round_robin", f"{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1009, doc_id) AS depth FROM scored) SELECT doc_id, source, CAST(depth AS INTEGER) AS depth FROM r WHERE depth <= 4 ORDER BY depth, source LIMIT 50")
def l03(spark, d):
    return sampling.round_robin(scored(spark, d), "source", "doc_id", 4, 50).select("doc_id", "source", "depth")


@book.add("l05_sequential_strata")
def l05(spark, d):
    wants = [("toxic", F.col("z") == 1, 15), ("bad", F.col("y") == 0, 15), ("rest", F.lit(True), 30)]
    return sampling.in_turn(scored(spark, d), wants, "source", "doc_id", 5).select("doc_id", "source", "stratum")


@book.add("l06_even_spread", f"{WITH}, n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM scored) SELECT source, doc_id FROM n WHERE i IN (CAST(round_even(0 * (n - 1) / 3.0, 0) AS BIGINT), CAST(round_even(1 * (n - 1) / 3.0, 0) AS BIGINT), CAST(round_even(2 * (n - 1) / 3.0, 0) AS BIGINT), n - 1)")
def l06(spark, d):
    return sampling.spread(scored(spark, d), "source", ["doc_id"], 4).select("source", "doc_id")


@book.add("l07_capped_examples", f"{WITH} SELECT lang, y, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, y ORDER BY s DESC, doc_id) AS k FROM scored) q WHERE k <= 3")
def l07(spark, d):
    return sampling.per_group(scored(spark, d), ["lang", "y"], [F.col("s").desc(), "doc_id"], 3).select("lang", "y", "doc_id")


@book.add("l10_serpentine_folds", f"{WITH}, g AS (SELECT source, round(avg(CAST(y AS DOUBLE)), 9) AS rate FROM scored GROUP BY source), i AS (SELECT *, row_number() OVER (ORDER BY rate DESC, source) - 1 AS i FROM g) SELECT source, rate, CAST(CASE WHEN CAST(floor(i / 5) AS BIGINT) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INTEGER) AS fold FROM i")
def l10(spark, d):
    return sampling.serpentine_folds(scored(spark, d), "source", "y", 5)


@book.add("l09_grouped_folds")
def l09(spark, d):
    return sampling.grouped_folds(scored(spark, d), "source", 5)


@book.add("l13_sub_windows", f"WITH {CURVE}, b AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM curve GROUP BY user_id), k AS (SELECT *, unnest([-1, 0, 1, 2, 3]) AS k FROM b) SELECT user_id, k, round(CASE WHEN k < 0 THEN lo ELSE lo + k * (hi - lo) / 4 END, 3) AS s, round(CASE WHEN k < 0 THEN hi ELSE lo + (k + 1) * (hi - lo) / 4 END, 3) AS e FROM k")
def l13(spark, d):
    b = curve(spark, d).groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(3))))
    at = lambda k: F.col("lo") + k * (F.col("hi") - F.col("lo")) / 4
    whole = F.col("k") < 0
    return b.select("user_id", "k", F.round(F.when(whole, F.col("lo")).otherwise(at(F.col("k"))), 3).alias("s"), F.round(F.when(whole, F.col("hi")).otherwise(at(F.col("k") + 1)), 3).alias("e"))


@book.add("l15_proportional_quota", f"{WITH}, c AS (SELECT lang, count(*) AS size FROM scored GROUP BY lang), t AS (SELECT sum(size) AS n, count(*) AS cells FROM c) SELECT lang, size, least(size, 1 + CAST(round_even(greatest(60 - cells, 0) * size / CAST(n AS DOUBLE), 0) AS BIGINT)) AS quota FROM c, t")
def l15(spark, d):
    return sampling.quotas(scored(spark, d), "lang", 60)


@book.add("l19_worklist", f"{WITH}, r AS (SELECT doc_id, y, z, s, row_number() OVER (PARTITION BY y ORDER BY s DESC, doc_id) AS k FROM scored) SELECT doc_id, CASE WHEN y = 0 AND k <= 5 THEN 'contradiction' WHEN z = 1 THEN 'contaminated' WHEN s < 0.1 THEN 'weak' ELSE 'remainder' END AS reason FROM r")
def l19(spark, d):
    k = F.row_number().over(W.partitionBy("y").orderBy(F.col("s").desc(), "doc_id"))
    r = scored(spark, d).withColumn("k", k)
    return r.select("doc_id", F.coalesce(rules.first_reason([("contradiction", (F.col("y") == 0) & (F.col("k") <= 5)), ("contaminated", F.col("z") == 1), ("weak", F.col("s") < 0.1)]), F.lit("remainder")).alias("reason"))
