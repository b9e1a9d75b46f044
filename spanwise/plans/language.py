"""Queries on label text, replies and JSON."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions import text as tx
from ..session import table
from .base import Book, r6

book = Book()


def rows_count():
    """The number of rows, as an aggregate; made when asked for, as columns need a session."""
    return F.count(F.lit(1))


TOK = "regexp_extract_all(lower(text), '[a-z]+')"
VERBS = {"the": "take", "and": "add", "is": "place", "of": "open", "on": "put"}
MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in VERBS.items()) + "}"


def bench(spark, d):
    return table(spark, d, "benchmark")


@book.add("f01_tokens", f"SELECT item_id, {TOK} AS tokens FROM benchmark")
def f01(spark, d):
    return bench(spark, d).select("item_id", tx.tokens(F.col("text")).alias("tokens"))


CANON = "list_filter(list_transform(" + TOK + ", lambda w: CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in VERBS.items()) + " END), lambda w: w IS NOT NULL)"


@book.add("f02_f03_canonical_verbs", f"SELECT item_id, {CANON} AS verbs, {CANON}[1] AS primary_verb FROM benchmark")
def f03(spark, d):
    verbs = tx.canonical(tx.tokens(F.col("text")), tx.dictionary(VERBS))
    return bench(spark, d).select("item_id", verbs.alias("verbs"), F.try_element_at(verbs, F.lit(1)).alias("primary_verb"))


@book.add("f04_longest_phrase_first")
def f04(spark, d):
    return bench(spark, d).select("item_id", tx.phrases(F.col("text"), ["of the", "the", "in", "on the", "and", "of"]).alias("phrases"))


@book.add("f05_contextual_fold", f"SELECT item_id, CASE WHEN v = 'take' AND o = 'of' THEN 'lift' ELSE v END AS verb FROM (SELECT item_id, {CANON}[1] AS v, {TOK}[1] AS o FROM benchmark) q")
def f05(spark, d):
    tokens = tx.tokens(F.col("text"))
    verb = F.try_element_at(tx.canonical(tokens, tx.dictionary(VERBS)), F.lit(1))
    return bench(spark, d).select("item_id", tx.folded(verb, F.try_element_at(tokens, F.lit(1)), tx.dictionary({"take:of": "lift"})).alias("verb"))


@book.add("f06_verb_clusters", f"SELECT item_id, list_contains({CANON}, 'take') OR list_contains({CANON}, 'open') AS handles, list_contains({CANON}, 'put') OR list_contains({CANON}, 'place') AS releases FROM benchmark")
def f06(spark, d):
    verbs = tx.canonical(tx.tokens(F.col("text")), tx.dictionary(VERBS))
    has = lambda *v: F.arrays_overlap(verbs, F.array(*[F.lit(x) for x in v]))
    return bench(spark, d).select("item_id", has("take", "open").alias("handles"), has("put", "place").alias("releases"))


@book.add("f07_jaccard", f"WITH t AS (SELECT item_id, list_distinct({TOK}) AS a FROM benchmark) SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.a, y.a)) / CAST(len(x.a) + len(y.a) - len(list_intersect(x.a, y.a)) AS DOUBLE), 6) AS jaccard FROM t x JOIN t y ON y.item_id = x.item_id + 1")
def f07(spark, d):
    t = bench(spark, d).select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("t"))
    nxt = t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return t.join(nxt, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), r6(tx.jaccard(F.col("t"), F.col("u"))).alias("jaccard"))


@book.add("f08_inverse_verbs", f"WITH v AS (SELECT item_id, {CANON}[1] AS a, {CANON}[2] AS b FROM benchmark) SELECT item_id, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN (a = 'take' AND b IN ('put', 'place')) OR (b = 'take' AND a IN ('put', 'place')) THEN 'inverse' WHEN a = b THEN 'same' ELSE 'other' END AS relation FROM v")
def f08(spark, d):
    verbs = tx.canonical(tx.tokens(F.col("text")), tx.dictionary(VERBS))
    a, b = F.try_element_at(verbs, F.lit(1)), F.try_element_at(verbs, F.lit(2))
    inverse = ((a == "take") & b.isin("put", "place")) | ((b == "take") & a.isin("put", "place"))
    return bench(spark, d).select("item_id", F.when(a.isNull() | b.isNull(), "unknown").when(inverse, "inverse").when(a == b, "same").otherwise("other").alias("relation"))


@book.add("f09_atomicity", r"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'repeat|again|back and forth') THEN 'cycle' WHEN len(list_filter(regexp_split_to_array(trim(text), '\s*(?:,|;|\band then\b|\bthen\b|\band\b)\s*'), lambda x: trim(x) <> '')) > 1 THEN 'compound' WHEN len(regexp_extract_all(lower(text), '[a-z]+')) <= 2 THEN 'terse' ELSE 'atomic' END AS tag FROM conversations")
def f09(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.atomicity(F.col("text")).alias("tag"))


@book.add("f10_clause_decomposition")
def f10(spark, d):
    c = bench(spark, d).select("item_id", F.posexplode(tx.clauses(F.col("text"))).alias("clause_no", "clause"))
    words = tx.tokens(F.col("clause"))
    verb = F.try_element_at(tx.canonical(words, tx.dictionary(VERBS)), F.lit(1))
    own = F.try_element_at(words, F.lit(-1))
    w = W.partitionBy("item_id").orderBy("clause_no")
    # a clause without words of its own inherits the object before it
    return c.withColumn("verb", verb).withColumn("object", F.last(own, ignorenulls=True).over(w)).select("item_id", "clause_no", "clause", "verb", "object")


@book.add("f11_word_swap", "SELECT doc_id, regexp_replace(text, '(^|[^A-Za-z])the([^A-Za-z]|$)', '\\1that\\2') AS swapped FROM documents WHERE lang = 'en' AND regexp_matches(text, '(^|[^A-Za-z])the([^A-Za-z]|$)') AND regexp_extract(text, '(?i)(^|[^A-Za-z])(the)([^A-Za-z]|$)', 2) = 'the'")
def f11(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'").withColumn("swapped", tx.swap_word(F.col("text"), "the", "that"))
    first = F.regexp_extract("text", "(?i)(^|[^A-Za-z])(the)([^A-Za-z]|$)", 2)
    return docs.where(first == "the").select("doc_id", "swapped")


@book.add("f12_counterfactuals")
def f12(spark, d):
    b = bench(spark, d)
    made = tx.counterfactuals(F.col("text"), F.lit("the"), F.lit("this"), F.lit("of"), F.lit("from"))
    return b.select("item_id", F.explode(made).alias("x")).select("item_id", "x.kind", "x.text", tx.well_formed(F.col("x.text")).alias("well_formed"))


@book.add("f13_compound_supervision", "WITH n AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), m AS (SELECT conv_id, turn, unnest([{'kind': 'original', 'text': a || ', then ' || b}, {'kind': 'reorder', 'text': b || ', then ' || a}, {'kind': 'drop_claim', 'text': a}, {'kind': 'paraphrase', 'text': a || ' and afterwards ' || b}]) AS x FROM n WHERE b IS NOT NULL) SELECT conv_id, turn, x.kind AS kind, x.text AS text FROM m")
def f13(spark, d):
    c = table(spark, d, "conversations").withColumn("label", F.col("text"))
    nxt = c.withColumn("next_label", F.lead("label").over(W.partitionBy("conv_id").orderBy("turn"))).where("next_label IS NOT NULL")
    a, b = F.col("label"), F.col("next_label")
    made = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in (("original", F.concat_ws(", then ", a, b)), ("reorder", F.concat_ws(", then ", b, a)), ("drop_claim", a), ("paraphrase", F.concat_ws(" and afterwards ", a, b)))])
    return nxt.select("conv_id", "turn", F.explode(made).alias("x")).select("conv_id", "turn", "x.kind", "x.text")


@book.add("f15_rendered_targets", "WITH s AS (SELECT l_orderkey, string_agg('<seg><name>' || l_returnflag || '</name><span>' || CAST(l_linenumber AS VARCHAR) || ' to ' || CAST(l_linenumber + 1 AS VARCHAR) || '</span></seg>', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, text FROM s")
def f15(spark, d):
    return rendered(spark, d)


def rendered(spark, d):
    n = F.col("l_linenumber")
    seg = F.concat(F.lit("<seg><name>"), "l_returnflag", F.lit("</name><span>"), n.cast("string"), F.lit(" to "), (n + 1).cast("string"), F.lit("</span></seg>"))
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", seg.alias("seg")).alias("x"))
    return li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["seg"]), "").alias("text"))


@book.add("s13_parse_segments", "SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS DOUBLE) AS starts FROM lineitem GROUP BY l_orderkey")
def s13(spark, d):
    segs = tx.parsed_segments(F.col("text"))
    return rendered(spark, d).select("l_orderkey", F.explode(segs).alias("s")).groupBy("l_orderkey").agg(rows_count().alias("n"), F.sum("s.start").alias("starts"))


SEG_SQL = r"(?is)<seg>\s*<name>(.*?)</name>\s*<span>\s*(\d+\.?\d*)\s*(?:to|[-–—])\s*(\d+\.?\d*)\s*</span>\s*</seg>"
VARIED = """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey, l_suppkey, '<' || CASE WHEN l_orderkey % 2 = 0 THEN 'seg' ELSE 'SEG' END || '> <name> ' || l_returnflag || '</name><span>' || CAST(l_linenumber AS VARCHAR) || '.5' || ['to', '-', '–', '—'][1 + l_linenumber % 4] || ' ' || CAST(l_linenumber + 1 AS VARCHAR) || CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 2 THEN '.2.3' ELSE '' END || '</span></' || CASE WHEN l_orderkey % 2 = 0 THEN 'seg' ELSE 'SEG' END || '>' AS seg FROM lineitem),
t AS (SELECT k, string_agg(seg, chr(10) ORDER BY CASE WHEN k % 3 = 0 THEN -n ELSE n END, l_partkey, l_suppkey) AS segs FROM s GROUP BY k),
c AS (SELECT k, CASE WHEN k % 5 = 0 THEN '<segments>' || segs || '</segments>' WHEN k % 7 = 0 THEN '<think>none</think><segments></segments>' WHEN k % 13 = 0 THEN 'so: <think>x</think><segments>' || segs || '</segments>' ELSE ' <think>' || chr(10) || 'plan' || chr(10) || '</think>' || chr(10) || '<segments>' || segs || '</segments> ' END AS text FROM t)"""


def varied(spark, d):
    """A completion an order, in many spellings: tags in capitals, four separators, malformed times, out of order, parts missing."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    tag = F.when(k % 2 == 0, "seg").otherwise("SEG")
    between = F.get(F.array(*[F.lit(x) for x in ("to", "-", "–", "—")]), (n % 4).cast("int"))
    seg = F.concat(F.lit("<"), tag, F.lit("> <name> "), "l_returnflag", F.lit("</name><span>"), n.cast("string"), F.lit(".5"), between, F.lit(" "), (n + 1).cast("string"), F.when((k % 11 == 0) & (n == 2), ".2.3").otherwise(""), F.lit("</span></"), tag, F.lit(">"))
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.when(k % 3 == 0, -n).otherwise(n).alias("at"), "l_partkey", "l_suppkey", seg.alias("seg")).alias("x"))
    segs = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["seg"]), "\n")
    t = li.groupBy("l_orderkey").agg(segs.alias("segs"))
    inner = F.concat(F.lit("<segments>"), "segs", F.lit("</segments>"))
    text = F.when(k % 5 == 0, inner).when(k % 7 == 0, "<think>none</think><segments></segments>").when(k % 13 == 0, F.concat(F.lit("so: <think>x</think>"), inner)).otherwise(F.concat(F.lit(" <think>\nplan\n</think>\n"), inner, F.lit(" ")))
    return t.select("l_orderkey", text.alias("text"))


@book.add("s13_parse_variants", f"{VARIED}, p AS (SELECT k, regexp_extract_all(text, '{SEG_SQL}', 1) AS names, list_transform(regexp_extract_all(text, '{SEG_SQL}', 2), lambda x: CAST(x AS DOUBLE)) AS starts, list_transform(regexp_extract_all(text, '{SEG_SQL}', 3), lambda x: CAST(x AS DOUBLE)) AS ends FROM c) SELECT k AS l_orderkey, list_transform(names, lambda x: trim(x)) AS names, starts, ends FROM p")
def s13_variants(spark, d):
    segs = tx.parsed_segments(F.col("text"))
    return varied(spark, d).select("l_orderkey", F.transform(segs, lambda x: x["label"]).alias("names"), F.transform(segs, lambda x: x["start"]).alias("starts"), F.transform(segs, lambda x: x["end"]).alias("ends"))


@book.add("a08_format_reward", f"{VARIED}, p AS (SELECT k, regexp_matches(text, '(?s)^\\s*<think>.*?</think>\\s*<segments>.*?</segments>\\s*$') AS whole, list_transform(regexp_extract_all(text, '{SEG_SQL}', 2), lambda x: CAST(x AS DOUBLE)) AS starts, list_transform(regexp_extract_all(text, '{SEG_SQL}', 3), lambda x: CAST(x AS DOUBLE)) AS ends FROM c) SELECT k AS l_orderkey, CASE WHEN NOT whole OR len(starts) = 0 THEN 0.0 WHEN starts = list_sort(starts) AND len(list_filter(list_zip(starts, ends), lambda z: z[2] <= z[1])) = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS reward FROM p")
def a08(spark, d):
    return varied(spark, d).select("l_orderkey", tx.format_reward(F.col("text")).alias("reward"))


@book.add("s14_reply_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s14(spark, d):
    e = table(spark, d, "events")
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Answer "), "props", F.lit(" done")))
    return e.select("event_id", F.get_json_object(tx.reply_object(reply), "$.k").cast("long").alias("k"))


@book.add("s15_reply_fields", "SELECT conv_id, turn, regexp_extract(text, '^(\\S+)', 1) AS first_word, regexp_extract(text, '(\\S+)\\s*$', 1) AS last_word FROM conversations")
def s15(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract("text", r"^(\S+)", 1).alias("first_word"), F.regexp_extract("text", r"(\S+)\s*$", 1).alias("last_word"))


@book.add("s16_claim_cells", "SELECT item_id, 2 AS actions, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS bad FROM benchmark")
def s16(spark, d):
    cell = F.concat(F.lit("take(cup); put(cup on table)[{slowly}]"), F.when(F.col("item_id") % 3 == 0, "; ???").otherwise(""))
    p = tx.parsed_actions(cell)
    return bench(spark, d).select("item_id", F.size(p["actions"]).alias("actions"), F.size(p["bad"]).alias("bad"))


PAIRED = f"WITH t AS (SELECT item_id, list_distinct({TOK}) AS a FROM benchmark), p AS (SELECT x.item_id, x.a AS g, y.a AS h FROM t x JOIN t y ON y.item_id = x.item_id + 1), s AS (SELECT item_id, len(list_filter(g, lambda v: NOT list_contains(h, v))) AS m, len(list_filter(h, lambda v: NOT list_contains(g, v))) AS e, len(list_intersect(g, h)) AS b FROM p)"


@book.add("f16_set_errors", f"{PAIRED} SELECT item_id, CASE WHEN m = 0 AND e = 0 THEN 'exact' WHEN e = 0 THEN 'omission' WHEN m = 0 THEN 'over' WHEN b > 0 THEN 'partial' ELSE 'substitution' END AS error FROM s")
def f16(spark, d):
    t = bench(spark, d).select("item_id", F.array_distinct(tx.tokens(F.col("text"))).alias("g"))
    nxt = t.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return t.join(nxt, "item_id").select("item_id", tx.set_error(F.col("g"), F.col("h")).alias("error"))


@book.add("f17_variant_diffs", "WITH n AS (SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CAST(role <> nr AS INTEGER) + CAST(text <> nt AS INTEGER) AS moved FROM n WHERE nt IS NOT NULL")
def f17(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    n = table(spark, d, "conversations").withColumn("nt", F.lead("text").over(w)).withColumn("nr", F.lead("role").over(w)).where("nt IS NOT NULL")
    return n.select("conv_id", "turn", ((F.col("role") != F.col("nr")).cast("int") + (F.col("text") != F.col("nt")).cast("int")).alias("moved"))


@book.add("f18_segment_tags", "SELECT conv_id, turn, list_filter([CASE WHEN length(text) < 80 THEN 'terse' END, CASE WHEN regexp_matches(text, ',') THEN 'compound' END, CASE WHEN role = 'system' THEN 'meta' END], lambda x: x IS NOT NULL) AS tags FROM conversations")
def f18(spark, d):
    tags = F.array_compact(F.array(F.when(F.length("text") < 80, "terse"), F.when(F.col("text").contains(","), "compound"), F.when(F.col("role") == "system", "meta")))
    return table(spark, d, "conversations").select("conv_id", "turn", tags.alias("tags"))


@book.add("a43_adjacent_repetition", "WITH n AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a, lead(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), j AS (SELECT conv_id, len(list_intersect(a, b)) / CAST(greatest(len(a) + len(b) - len(list_intersect(a, b)), 1) AS DOUBLE) AS j FROM n WHERE b IS NOT NULL) SELECT conv_id, round(avg(j), 6) AS similarity, CASE WHEN avg(j) >= 0.1 THEN 'A' ELSE 'B' END AS verdict FROM j GROUP BY conv_id")
def a43(spark, d):
    t = F.array_distinct(tx.tokens(F.col("text")))
    n = table(spark, d, "conversations").select("conv_id", "turn", t.alias("a")).withColumn("b", F.lead("a").over(W.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    both = F.size(F.array_intersect("a", "b"))
    j = n.withColumn("j", both / F.greatest(F.size("a") + F.size("b") - both, F.lit(1)))
    return j.groupBy("conv_id").agg(r6(F.avg("j")).alias("similarity"), F.when(F.avg("j") >= 0.1, "A").otherwise("B").alias("verdict"))


@book.add("g03_box_geometry", "WITH b AS (SELECT o_orderkey, (o_orderkey % 50) * 1.0 AS x0, (o_orderkey % 30) * 1.0 AS y0, (o_orderkey % 50) + 20.0 AS x1, (o_orderkey % 30) + 10.0 AS y1 FROM orders) SELECT o_orderkey, round(CAST(greatest(least(x1, 40.0) - greatest(x0, 10.0), 0) * greatest(least(y1, 25.0) - greatest(y0, 5.0), 0) / (200.0 + 600.0 - greatest(least(x1, 40.0) - greatest(x0, 10.0), 0) * greatest(least(y1, 25.0) - greatest(y0, 5.0), 0)) AS DOUBLE), 6) AS iou, x0 <= 1 OR y0 <= 1 OR x1 >= 99 OR y1 >= 99 AS touches FROM b")
def g03(spark, d):
    k = F.col("o_orderkey")
    b = {"x0": (k % 50) * 1.0, "y0": (k % 30) * 1.0, "x1": (k % 50) + 20.0, "y1": (k % 30) + 10.0}
    other = {"x0": F.lit(10.0), "y0": F.lit(5.0), "x1": F.lit(40.0), "y1": F.lit(25.0)}
    return table(spark, d, "orders").select("o_orderkey", r6(sc.box_iou(b, other)).alias("iou"), sc.edge_touch(b, 100, 100, 0.01).alias("touches"))


@book.add("g04_contact_state", "WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(10 - l_quantity, l_quantity - 30, 0) AS gap FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN gap = 0 THEN 'contact' WHEN gap <= 5 THEN 'near' ELSE 'free' END AS state FROM g")
def g04(spark, d):
    gap = sc.interval_distance(F.col("l_quantity"), F.lit(10.0), F.lit(30.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(gap == 0, "contact").when(gap <= 5, "near").otherwise("free").alias("state"))
