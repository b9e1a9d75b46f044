"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import math
import os

import pytest

from spanwise.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_names_of_registry():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def groups_by_brute_force(texts):
    import re

    sets = {i: set(re.findall("[a-z]+", t.lower())) for i, t in texts.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                union = sets[a] | sets[b]
                if (len(sets[a] & sets[b]) / len(union) if union else 1.0) >= 0.15:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in root) and not any(root[a] != root[b] for a in sets for b in sets if (len(sets[a] & sets[b]) >= 0.15 * len(sets[a] | sets[b]))):
            return root
    return root


def test_similar_groups_of_common_words_only(spark, tmp_path):
    """Items that share only words which more than twenty items have, as benchmarks grow."""
    texts = {i: "common words of all " + " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[j]}{'uvwxyzabcd'[i // 10]}" for j in range(4 + i % 6)) for i in range(60)} | {90: "", 91: "1", 92: "alone here"}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.root for r in registry.QUERIES["u08_similar_label_groups"](spark, str(tmp_path)).collect()}
    assert got == groups_by_brute_force(texts)
    assert got[59] == 0 and got[91] == 90 and got[92] == 92


def test_compound_targets_hold_whole_turns(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, 0, "user", long), (1, 1, "assistant", "short " + long), (1, 2, "user", "end")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.turn, r.kind): r.text for r in registry.QUERIES["f13_compound_supervision"](spark, str(tmp_path)).collect()}
    assert got[0, "original"] == f"{long}, then short {long}" and got[0, "drop_claim"] == long
    assert got[1, "reorder"] == f"end, then short {long}" and len(got) == 8
