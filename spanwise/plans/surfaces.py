"""Queries on surfaces for the caller's own code: scorers, table functions, cell grammars, linked labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims as cl
from ..functions import generators
from ..operators import failures, graph, overlap, scorers
from ..operators.lineage import settled
from ..session import table
from . import further, language
from .base import HOUR, TOL, Book, r6, segments
from .temporal import decoded

book = Book()
GRADES = ("tiny", "short", "medium", "long", "huge")
GRADE_SQL = "['tiny', 'short', 'medium', 'long', 'huge'][p_size % 5 + 1]"


def named_parts(spark, d):
    """Parts as labels of a brand: the type is the verb, the name's words and a grade are what it is done to."""
    grade = F.element_at(F.array(*map(F.lit, GRADES)), (F.col("p_size") % 5 + 1).cast("int"))
    words = F.array_distinct(F.filter(F.split(F.concat_ws(" ", F.lower("p_name"), grade), " +"), lambda w: F.length(w) > 2))
    return table(spark, d, "part").select("p_brand", "p_partkey", F.lower("p_type").alias("verb"), words.alias("words"))


@book.add("u08_same_object_groups", f"WITH RECURSIVE i AS (SELECT p_brand, p_partkey AS k, lower(p_type) AS verb, list_distinct(list_filter(string_split(lower(p_name) || ' ' || {GRADE_SQL}, ' '), lambda w: length(w) > 2)) AS w FROM part), l AS (SELECT a.k AS a, b.k AS b FROM i a JOIN i b ON a.p_brand = b.p_brand AND a.verb <> b.verb WHERE len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) >= 0.4), r AS (SELECT k, k AS root FROM i UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.k), g AS (SELECT k, min(root) AS root FROM r GROUP BY k), n AS (SELECT g.root, count(DISTINCT i.verb) AS verbs FROM g JOIN i USING (k) GROUP BY g.root) SELECT i.p_brand, g.k AS p_partkey, g.root, n.verbs FROM g JOIN n USING (root) JOIN i USING (k) WHERE n.verbs >= 3")
def u08_groups(spark, d):
    """Labels of a brand about the same object with different verbs, linked at a Jaccard of 0.4; groups of three verbs or more."""
    items = named_parts(spark, d).withColumn("words", F.array_sort("words"))
    # labels with one verb and the same words have the same links, so that one of them, the first, stands for all;
    # one without links is in no group of three verbs, whatever the number of its likes
    alike = ["p_brand", "verb", "words"]
    kinds = settled(items.where("verb IS NOT NULL").groupBy(*alike).agg(F.min("p_partkey").alias("first")))
    links = overlap.overlap_links(kinds, ["p_brand"], "first", "words", 0.4, apart="verb").select("a", "b")
    groups = settled(graph.linked_groups(kinds.select("first"), links, "first").join(kinds, "first"))
    verbs = groups.groupBy("root").agg(F.countDistinct("verb").alias("verbs")).where("verbs >= 3")
    return items.join(groups.join(verbs, "root"), alike).select("p_brand", "p_partkey", "root", "verbs")


@book.add("a09_name_reward_by_scorer", further.book.oracles["a09_name_reward"])
def a09_scored(spark, d):
    """The name reward with a scorer that runs in Python on distinct pairs; the same rows as the column form."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    pairs = t.join(t.select("conv_id", F.col("turn").alias("o"), F.col("text").alias("said")), "conv_id")  # turns of one conversation
    p = scorers.score_pairs(pairs, "text", "said", "letters")
    nxt = F.col("o") == F.col("turn") + 1
    r = p.groupBy("conv_id", "turn").agg(F.max(F.when(nxt, F.col("score"))).alias("own"), F.max(F.when(~nxt & (F.col("o") != F.col("turn")), F.col("score"))).alias("other")).where("own IS NOT NULL")
    return r.select("conv_id", "turn", r6(F.greatest(F.lit(0.0), F.col("own") - 0.5 * F.coalesce("other", F.lit(0.0)))).alias("reward"))


@book.add("s16_claim_grammar", "WITH t AS (SELECT conv_id, turn, length(text) AS n, length(text) % 11 = 0 AS bad FROM conversations), g AS (SELECT conv_id, CAST(count(*) FILTER (WHERE NOT bad) AS BIGINT) AS actions, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS b, CAST(coalesce(sum(n % 7) FILTER (WHERE NOT bad), 0) AS BIGINT) AS objects, CAST(coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS BIGINT) AS nested FROM t GROUP BY conv_id) SELECT conv_id, actions, greatest(actions - 1, 0) AS relations, b + CAST(conv_id % 3 = 0 AS INT) AS bad, objects, nested FROM g")
def s16(spark, d):
    """Claim cells of conversations, an action a turn and a relation between neighbours; some lines do not parse."""
    n = F.length("text")
    line = F.when(n % 11 == 0, F.concat(F.lit("?? "), "role")).otherwise(F.concat("role", F.lit("(obj "), (n % 7).cast("string"), F.lit(")[{turn: "), F.col("turn").cast("string"), F.lit(", 'tags': [x, {long: "), n.cast("string"), F.lit("}]}]")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "; ").alias("cell"), F.count_if(n % 11 != 0).cast("int").alias("good"))
    of = F.transform(F.filter(F.sequence(F.lit(0), F.col("good")), lambda k: (k > 0) & (k < F.col("good"))), lambda k: F.concat(F.lit("before(a"), k.cast("string"), F.lit(", a"), (k + 1).cast("string"), F.lit(")")))
    stray = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("after(a1, a99)"))).otherwise(F.array().cast("array<string>"))
    told = rows.select("conv_id", cl.claims(F.col("cell"), F.array_join(F.concat(of, stray, F.array(F.lit("none"))), "\n")).alias("c"))
    add = lambda x: F.aggregate(F.transform("c.actions", x), F.lit(0).cast("long"), lambda acc, v: acc + v.cast("long"))
    return told.select("conv_id", F.size("c.actions").cast("long").alias("actions"), F.size("c.relations").cast("long").alias("relations"), F.size("c.bad").cast("long").alias("bad"), add(lambda a: F.substring_index(a["object"], " ", -1)).alias("objects"), add(lambda a: F.get_json_object(a["qualifiers"], "$.tags[1].long")).alias("nested"))


@book.add("f13_by_table_function", language.book.oracles["f13_compound_supervision"])
def f13_sql(spark, d):
    """Compound supervision by a table function in SQL; the same rows as the column form."""
    generators.register(spark)
    table(spark, d, "conversations").createOrReplaceTempView("spanwise_conversations")
    return spark.sql("SELECT conv_id, turn, kind, made AS text FROM compound_supervision(TABLE(spanwise_conversations), 'conv_id', 'turn', 'text')")


@book.add("f12_by_table_function")
def f12_sql(spark, d):
    """Counterfactual labels by a table function in SQL; the same rows as the column form."""
    generators.register(spark)
    table(spark, d, "benchmark").createOrReplaceTempView("spanwise_benchmark")
    return spark.sql("SELECT item_id, kind, made AS text FROM counterfactuals(TABLE(spanwise_benchmark), 'text', 'the', 'this', 'of', 'from')")


@book.add("a44_failure_audit")
def a44(spark, d):
    """Missed boundaries by kind of change, where false peaks lie, recordings that stand out, and examples."""
    out = failures.audit(decoded(spark, d), segments(spark, d), "user_id", "t", "i", TOL, 24 * HOUR)
    return out.select("part", "name", "n", "of", r6("value").alias("value"))
