"""Overlap links, scorers, cell grammars, table functions and frozen models against plain versions."""

import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.functions import claims, generators
from spanwise.operators import digests, overlap, scorers, segmentation
from spanwise.plans import registry
from spanwise.sources import sinks

SF = "/root/testdata/sf0.001"


# ---- overlap links


@pytest.mark.parametrize("threshold", [0.15, 0.4, 0.8, 1.0])
@pytest.mark.parametrize("most", [4096, 5])
def test_overlap_links_match_all_pairs(spark, monkeypatch, threshold, most):
    """Words that half of all items hold, in blocks of five too; items without words and with equal verbs."""
    monkeypatch.setattr(overlap, "MOST_ROWS", most)
    rng = random.Random(int(threshold * 100))
    rows = []
    for rec in (1, 2):
        for i in range(70):
            words = [w for w in ("all", "most") if rng.random() < 0.5] + [f"w{rng.randrange(12)}" for _ in range(rng.randrange(6))]
            rows.append((rec, i, words, rng.choice("abc")))
    rows += [(1, 500, [], "a"), (1, 501, None, "b"), (1, 502, ["w1", None], "a"), (1, 503, ["w1"], "b")]
    items = spark.createDataFrame(rows, "rec long, id long, words array<string>, verb string")
    for apart in (None, "verb"):
        got = {(r.rec, r.a, r.b): r.jaccard for r in overlap.overlap_links(items, ["rec"], "id", "words", threshold, apart).collect()}
        want = {}
        for rec, i, w, v in rows:
            for other, j, x, u in rows:
                a, b = {y for y in w or [] if y}, {y for y in x or [] if y}
                if rec == other and i < j and a and b and len(a & b) / len(a | b) >= threshold and (apart is None or v != u):
                    want[rec, i, j] = len(a & b) / len(a | b)
        assert got == pytest.approx(want)


# ---- scorers


def counting(folder):
    """A scorer that leaves a file for each pair that it scores, and fails on some."""

    def factory():
        import tempfile

        def score(a, b):
            if "poison" in a + b:
                raise ValueError("poison")
            for x, y in zip(a, b):
                with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, suffix=".pair") as f:
                    f.write(f"{x}|{y}")
            return [float("nan") if x == "odd" else float(len(x) == len(y)) for x, y in zip(a, b)]

        return score

    factory.__qualname__ = f"counting-{folder}"
    return factory


def test_each_distinct_pair_is_scored_once(spark, tmp_path):
    rows = [("a", "b")] * 40 + [("a", "cc"), ("odd", "x"), (None, "x"), ("x", None)] * 3
    frame = spark.createDataFrame(rows, "said string, name string").repartition(7)
    got = scorers.score_pairs(frame, "said", "name", counting(str(tmp_path)), batch=2).collect()
    assert len(got) == len(rows)
    assert {(r.said, r.name): (r.score, r.error) for r in got} == {("a", "b"): (1.0, None), ("a", "cc"): (0.0, None), ("odd", "x"): (None, None), (None, "x"): (None, None), ("x", None): (None, None)}
    assert sorted(open(tmp_path / f).read() for f in os.listdir(tmp_path)) == ["a|b", "a|cc", "odd|x"]


def test_failures_are_rows_of_their_own(spark, tmp_path):
    frame = spark.createDataFrame([("a", "b"), ("poison", "b"), ("c", "d"), ("cc", "d")], "said string, name string").coalesce(1)
    got = {(r.said, r.name): (r.score, r.error) for r in scorers.score_pairs(frame, "said", "name", counting(str(tmp_path))).collect()}
    assert got == {("a", "b"): (1.0, None), ("poison", "b"): (None, "ValueError: poison"), ("c", "d"): (1.0, None), ("cc", "d"): (0.0, None)}


def test_registry_of_scorers(spark):
    with pytest.raises(ValueError, match="no scorer 'none'"):
        scorers.factory_of("none")
    frame = spark.createDataFrame([("Pour Water", "pour water"), ("", ""), ("fold", "sheet")], "a1 string, b1 string")
    got = {name: [round(r.score, 6) for r in scorers.score_pairs(frame, "a1", "b1", name).orderBy(F.desc("a1")).collect()] for name in ("equal", "words", "trigrams", "mock")}
    assert got["equal"] == [0.0, 0.0, 1.0] and got["words"] == [0.0, 1.0, 1.0] and got["trigrams"][1] == 1.0
    assert got["mock"] == [round(x, 6) for x in scorers._mock()(["fold", "Pour Water", ""], ["sheet", "pour water", ""])]


def test_name_reward_by_a_scorer_is_that_of_columns(spark):
    rng = random.Random(4)
    pred = spark.createDataFrame([(r, p, rng.choice(["fold", "pour", "stir"]), 10.0 * p + rng.random(), 10.0 * p + 8) for r in range(20) for p in range(4)], "rec long, p long, label string, s double, e double")
    true = spark.createDataFrame([(r, g, rng.choice(["fold", "pour", "stir"]), 10.0 * g, 10.0 * g + 8) for r in range(20) for g in range(3)], "rec long, g long, label string, gs double, ge double")
    column = {r.rec: r.name_reward for r in segmentation.name_reward(pred, true, ["rec"], lambda a, b: (a == b).cast("double")).collect()}
    assert {r.rec: r.name_reward for r in segmentation.name_reward_by(pred, true, ["rec"], "equal").collect()} == pytest.approx(column)
    assert len(set(column.values())) > 2


# ---- claim cells

words = st.text(st.sampled_from("abcXYZ_é09"), min_size=1, max_size=6)
verbs = st.from_regex(r"[a-z_][a-z_-]{0,6}", fullmatch=True)
texts = st.text(st.sampled_from("ab ;,:(){}[]\"'\\é1"), max_size=8).map(str)
values = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.integers(-99, 99).map(lambda k: k / 4) | texts, lambda v: st.lists(v, max_size=3) | st.dictionaries(texts.filter(bool), v, max_size=3), max_leaves=6)
actions = st.builds(lambda v, o, q: {"verb": v, "object": o, "qualifiers": json.dumps(q, sort_keys=True, ensure_ascii=False)}, verbs, st.none() | texts.filter(bool), st.dictionaries(texts.filter(bool), values, max_size=3))


@settings(max_examples=300, deadline=None)
@given(st.lists(actions, max_size=4), st.data())
def test_claims_come_back(made, data):
    n = len(made)
    places = st.integers(1, max(1, n))
    relations = data.draw(st.lists(st.builds(lambda r, a, b: {"relation": r, "first": a, "second": b}, verbs.filter(lambda v: v != "none"), places, places), max_size=3)) if n else []
    parts = {"actions": made, "relations": relations, "bad": []}
    assert claims.parsed(*claims.rendered(parts)) == parts


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab(){}[]:,;\n\"'\\ 1?"), max_size=30), st.text(st.sampled_from("ab(1),;\n "), max_size=20))
def test_any_cell_is_read_or_listed(cell, relations):
    out = claims.parsed(cell, relations)
    read = len(out["actions"]) + len(out["relations"]) + len(out["bad"])
    assert read == len(claims.lines(cell)) + sum(x.lower() != "none" for x in claims.lines(relations))


def test_claim_cells_of_known_forms(spark):
    cells = [("put(cup on table)[{slowly}]; ???\nTake( )", "Before(a1 , A2)"), ("a(b)[{k: [1, 2.5, {x: null}], 'q;': true}]", "before(a1, a2); none; next"), (None, None), ("a(b))", ""), ("a(b)[{k: }]; c(d)[{k: 1}, {m: 2}]", "")]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cells)], "k int, a string, r string")
    got = {r.k: r.c for r in rows.select("k", claims.claims(F.col("a"), F.col("r")).alias("c")).collect()}
    assert [(x.verb, x.object, x.qualifiers) for x in got[0].actions] == [("put", "cup on table", '{"slowly": true}'), ("take", None, "{}")] and got[0].bad == ["???"]
    assert [tuple(x) for x in got[0].relations] == [("before", 1, 2)]
    assert json.loads(got[1].actions[0].qualifiers) == {"k": [1, 2.5, {"x": None}], "q;": True} and got[1].bad == ["before(a1, a2)", "next"] and not got[1].relations
    assert not got[2].actions and not got[2].bad and got[3].bad == ["a(b))"]
    assert got[4].bad == ["a(b)[{k: }]"] and json.loads(got[4].actions[0].qualifiers) == {"k": 1, "m": 2}


# ---- table functions


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("sql, columns", [("f13_by_table_function", "f13_compound_supervision"), ("f12_by_table_function", "f12_counterfactuals")])
def test_table_functions_give_the_rows_of_the_column_forms(spark, sql, columns):
    got = registry.QUERIES[sql](spark, SF)
    want = registry.QUERIES[columns](spark, SF).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


def test_table_functions_on_other_tables(spark):
    rows = spark.createDataFrame([("r", 2, "b", 1), ("r", 1, "a", 1), ("r", 3, None, 1), ("q", 5, "z", 1), ("r", 4, "d", 1)], "rec string, at int, label string, kind2 int")
    got = sorted(map(tuple, generators.compounds_of(rows, "rec", "at", "label").collect()))
    assert got == [("r", 1, "drop_claim", "a"), ("r", 1, "original", "a, then b"), ("r", 1, "paraphrase", "a and afterwards b"), ("r", 1, "reorder", "b, then a"), ("r", 3, "drop_claim", None), ("r", 3, "original", "d"), ("r", 3, "paraphrase", "d"), ("r", 3, "reorder", "d")]
    with pytest.raises(Exception, match="no column 'name'"):
        generators.compounds_of(rows, "rec", "at", "name").collect()
    assert generators.compounds_of(rows.limit(0), "rec", "at", "label").count() == 0


# ---- digests and frozen models


def test_content_digest_tells_contents_not_order(spark):
    rows = [(1, "a", 2.0, [1, 2]), (2, None, None, None), (2, None, None, None), (3, "", float("nan"), [])]
    of = lambda data, kind="k long, t string, x double, v array<int>": digests.content_digest(spark.createDataFrame(data, kind))
    same = of(rows)
    frame = spark.createDataFrame(rows, "k long, t string, x double, v array<int>")
    assert same == of(rows[::-1]) == digests.content_digest(frame.repartition(5)) == digests.content_digest(frame.select("v", "x", "t", "k"))
    changed = [rows[:-1], [*rows, rows[0]], [(1, "b", 2.0, [1, 2]), *rows[1:]], [(1, "a", 2.0, [2, 1]), *rows[1:]], [*rows[:3], (3, None, float("nan"), [])], [*rows[:3], (3, "", float("nan"), None)]]
    assert len({same, *map(of, changed), digests.content_digest(frame.withColumnRenamed("t", "u")), digests.content_digest(frame.withColumn("k", F.col("k").cast("int")))}) == len(changed) + 3
    assert of([]) == of([]) != same


def test_fingerprints_of_ids(spark):
    import hashlib

    rows = [(s, i) for s in ("a", "b", None) for i in random.Random(str(s)).sample(range(500), 60)] * 2 + [("a", None)]
    got = {r.s: r.fingerprint for r in digests.fingerprints(spark.createDataFrame(rows, "s string, i long").repartition(6), "s", "i").collect()}
    want = {s: hashlib.sha256("".join(x + "\x1f" for x in sorted({str(i) for t, i in rows if t == s and i is not None})).encode()).hexdigest()[:16] for s in ("a", "b", None)}
    assert got == want


def test_frozen_model_is_guarded(spark, tmp_path):
    inputs = spark.createDataFrame([(k, float(k)) for k in range(30)], "event long, x double")
    fitted, fresh = inputs.where("event < 10"), inputs.where("event >= 20")
    path = str(tmp_path / "model")
    sinks.freeze(spark, path, {"whole": {"weight": [1.5]}, "local": {"weight": [2.0]}}, {"features": inputs}, fitted, "event")
    model, rows = sinks.thaw(spark, path, ["local"], {"features": inputs.repartition(4).orderBy(F.desc("event"))}, fresh)
    assert model == {"local": {"weight": [2.0]}} and {r.in_sample for r in rows.collect()} == {False}
    with pytest.raises(ValueError, match="features has changed"):
        sinks.thaw(spark, path, ["local"], {"features": inputs.withColumn("x", F.col("x") + F.when(F.col("event") == 7, 1e-9).otherwise(0.0))}, fresh)
    with pytest.raises(ValueError, match="not given"):
        sinks.thaw(spark, path, ["local"], {}, fresh)
    with pytest.raises(ValueError, match=r"no scorer for \['fused'\]"):
        sinks.thaw(spark, path, ["local", "fused"], {"features": inputs}, fresh)
    mixed = inputs.where("event BETWEEN 8 AND 12")
    with pytest.raises(ValueError, match="were in the set"):
        sinks.thaw(spark, path, ["local"], {"features": inputs}, mixed)
    _, rows = sinks.thaw(spark, path, ["local"], {"features": inputs}, mixed, allow_in_sample=True)
    assert {r.event: r.in_sample for r in rows.collect()} == {8: True, 9: True, 10: False, 11: False, 12: False}
