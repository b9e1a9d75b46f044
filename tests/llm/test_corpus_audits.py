"""Whitening, chat formatting and the divergence audit against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanwise.llm import chat, divergence, queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int, n long, x binary"
TURNS = "conv_id long, turn long, role string, text string, rows int, mask string"
DOCS = "doc_id long, text string, lang string, source string, term long, n string"


# ---- whitening


def plain_whitening(vectors):
    """x, n, deviations, whitened and explained by numpy on one machine."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(axis=0)
    d = distinct - distinct.mean(axis=0)
    e, v = np.linalg.eigh(d.T @ d / n)
    order = np.argsort(-e)[:16]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, (x - s / n) @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("width", [1, 3, 24])
def test_whitening_matches_numpy(spark, width):
    rng = np.random.default_rng(width)
    mixed = rng.normal(size=(width, width)) * rng.uniform(0.2, 9, size=width)
    good = (rng.normal(size=(400, width)) @ mixed).astype(np.float32)
    good[50:170] = good[7]  # a group of copies
    vectors = good.tolist()
    odd = [None, [], [1.0] * (width + 1), [None] * width, [math.nan] * width, [math.inf] + [0.0] * (width - 1)]
    rows = [(i, v, 0, 5, b"") for i, v in enumerate(vectors)] + [(3, vectors[3], 0, 5, b""), (None, vectors[4], 1, 5, b"")] + [(1000 + i, v, 0, 5, b"") for i, v in enumerate(odd)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(7)).toPandas()
    n, deviation, white, explained = plain_whitening(vectors)
    k = min(16, width)
    assert len(got) == 402 * k and n <= 281 and set(got.n) == {n}
    assert (got[got.vec_id == 3].groupby("component").size() == 2).all() and got.vec_id.isna().sum() == k
    by = got.dropna().drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component")
    assert by["deviation"].to_numpy()[:, 0].tolist() == deviation
    mine = by["whitened"].to_numpy()
    sign = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * sign, white, atol=1e-8)
    assert np.allclose(by["explained"].to_numpy()[0], explained, rtol=1e-9)
    assert got.identity_error.max() == got.identity_error.min() < 1e-9


def test_whitening_of_few_alike_and_large(spark):
    def run(vectors):
        return whitening.whiten(spark.createDataFrame([(i, v, 0, 0, b"") for i, v in enumerate(vectors)], VECTORS)).collect()

    assert run([]) == [] and run([None, []]) == [] and run([[1.0, 2.0]]) == [] and run([[1.0, 2.0]] * 9) == []
    flat = run([[float(i), 5.0] for i in range(10)])  # one direction has variance
    assert len(flat) == 10 and {r.component for r in flat} == {1} and all(r.explained == 1.0 for r in flat)
    huge = run([[3e38, 1.0], [-3e38, 2.0], [0.0, 4.0]])
    assert len(huge) == 3 and all(r.deviation is None for r in huge if abs(r.whitened) > 1)
    wide = run([[1e9, 0.0], [0.0, 1.0], [3.0, 2.0]])
    x = [[math.floor(64 * float(np.float32(c))) for c in v] for v in ([1e9, 0.0], [0.0, 1.0], [3.0, 2.0])]
    want = [sum((3 * a - sum(c)) ** 2 for a, c in zip(v, zip(*x))) for v in x]
    assert {r.vec_id: r.deviation for r in wide} == {i: w if w < 2**63 else None for i, w in enumerate(want)}


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, size=(500, 6)) + 10_000
    whole = whitening.moments_of(x, True)
    cuts = [0, 1, 7, 7, 130, 131, 480, 500]
    parts = [whitening.moments_of(x[a:b], True) if b > a else None for a, b in zip(cuts, cuts[1:])]
    random.Random(1).shuffle(parts)
    while len(parts) > 1:
        parts = [whitening.merged(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    got = parts[0]
    assert got.n == 500 and got.sums.tolist() == whole.sums.tolist() == x.sum(axis=0).tolist()
    assert np.allclose(got.mean, x.mean(axis=0)) and np.allclose(got.scatter, np.cov(x.T) * 499)


def test_packed_vectors_come_back():
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(-m, m, 5) for m in (1, 1 << 15, 1 << 16, 1 << 31, 1 << 33, 1 << 48)])
    x[1, 0], x[2, 0] = -(1 << 15), 1 << 15
    cells = whitening.packed(x)
    assert [len(c) for c in cells] == [10, 10, 20, 20, 40, 40] and (whitening.unpacked(cells, 5) == x).all()


# ---- chat


def plain_digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = b"".join(t for r, t in turns if r == b"assistant")
        out[conv] = (len(turns), hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest())
    return out


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<turn", "</turn", "<turn/>", "\\", "<", "</turn>\n", "\n", "é", "😀", "<turn user>\n", "a", "", ">", "%", "<\\turn", "<\\\\/turn", "$1"]
    roles = ["user", "assistant", "system", "a>b", "%3E<\n", "", None, "<turn"]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(30)]), rng.choice(roles), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))]), 1, "x") for _ in range(300)]
    rows += [(5, 0, "user", "only a user", 1, "x"), (6, 0, "assistant", "<turn/>" * 20_000, 1, "x"), (7, 1, "user", "twice", 1, "x"), (7, 1, "user", "twice", 1, "x")]
    probe = [(-7, k, r, "\\### Assistant: </turn> ok", 1, "x") for k, r in enumerate(("user", "assistant"))]
    made = chat.format_conversations(chat.with_probe(spark.createDataFrame(rows, TURNS)))
    got = {r.conv_id: tuple(r)[1:] for r in chat.digest(made).collect()}
    assert {k: v[:4] for k, v in got.items()} == plain_digests(rows + probe)
    for r in made.collect():
        assert got[r.conv_id][4] == len(r.formatted) == sum(m.chars for m in r.mask)
        assert len(re.findall("<turn [^>]*>\n", r.formatted)) == r.formatted.count("</turn>\n")
    seven = next(r for r in made.collect() if r.conv_id == 7)
    assert seven.formatted == "<turn user>\ntwice<turn/>twice</turn>\n" and not any(m.loss for m in seven.mask)


def test_chat_long_empty_and_torn(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"text {i} <turn>", 0, "") for i in range(20_000)]
    got = chat.digest(chat.format_conversations(spark.createDataFrame(rows, TURNS))).collect()
    assert len(got) == 1 and tuple(got[0])[1:5] == plain_digests(rows)[1]
    none = spark.createDataFrame([], TURNS)
    assert chat.digest(chat.format_conversations(none)).count() == 0
    assert [r.conv_id for r in chat.digest(chat.format_conversations(chat.with_probe(none))).collect()] == [-7]
    torn = chat.format_conversations(spark.createDataFrame(rows[:4], TURNS)).selectExpr("conv_id", "replace(formatted, 'text 1', 'text one') AS formatted", "mask")
    with pytest.raises(Exception, match="runs are not those"):
        chat.digest(torn).collect()


def test_chat_runs_no_python(spark):
    plan = chat.digest(chat.format_conversations(chat.with_probe(spark.createDataFrame([], TURNS))))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- divergence


def plain_audit(rows, least=30, top=50):
    """The report by counting every term of every pair."""
    words = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {w[0] for w in words}:
        held = Counter(t for a, _, ws in words if a == lang for t in set(ws))
        keep = [t for t, n in held.items() if n >= least]
        groups = {s: Counter() for a, s, _ in words if a == lang}
        for a, s, ws in words:
            if a == lang:
                groups[s].update(t for t in ws if held[t] >= least)
        whole = sum(groups.values(), Counter())

        def p(counter, t):
            return 1 + 10**9 * (counter[t] + 5) // (sum(counter.values()) + 5 * len(keep))

        def ranked(s, part, values, most=None):
            order = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
            out.update((lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(order))

        for s, c in groups.items():
            ranked(s, "pair", [(o, sum(abs(p(c, t) - p(d, t)) for t in keep)) for o, d in groups.items() if o != s])
            ranked(s, "term", [(t, p(c, t) - p(whole, t)) for t in keep if c[t] and p(c, t) > p(whole, t)], top)
    return out


@pytest.mark.parametrize("block", [64, 2])
def test_divergence_matches_plain_counts(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "HELD", 500)
    if block == 2:
        # workers import the module anew: the blocks of the driver's plan and of the tasks must be one
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "_tallied", _with_block(divergence._tallied, block))
    rng = random.Random(6)
    words = ["w%s" % "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)] + ["Straße", "ÉTÉ", "été", "日本", "x y"]
    rows = []
    for i in range(420):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "B", "é", "", None, "z9"])
        bias = words[: 20 + 5 * len(source or "")]
        rows.append((i, " ".join(rng.choice(bias if rng.random() < 0.5 else words) for _ in range(rng.randrange(60))), lang, source, 7, "n"))
    rows += [(None, None, "en", "none", 7, "n"), (1, "", "empty", "s", 7, "n"), (1, "a b", "empty", "t", 7, "n"), (2, "12 34", "one", "s", 7, "n"), (3, "many " * 50_000, "en", "z9", 7, "n")]
    rows += [rows[5]] * 3
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOCS).repartition(5)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows)
    assert {r[4] for r in got if r[0] == "empty"} == {0}


def _with_block(f, block):
    def run(batches):
        from spanwise.llm import divergence as d

        before, d.BLOCK = d.BLOCK, block
        try:
            yield from f(batches)
        finally:
            d.BLOCK = before

    return run


def test_divergence_large_counts_and_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    pair, a, b = np.array([9, 9, 9, 1 << 40]), np.array([1 << 45, 3, 3, 2]), np.array([5, 1 << 50, 1 << 50, 2])
    got = divergence._unique(pair, a, b, np.array([1, 2, 3, 4]))
    assert sorted(zip(*(x.tolist() for x in got))) == [(9, 3, 1 << 50, 5), (9, 1 << 45, 5, 1), (1 << 40, 2, 2, 4)]


def test_new_queries_are_registered():
    assert {"op11_whitening", "op12_chat_format", "op13_divergence"} <= set(queries.QUERIES)
    assert {"op12_chat_format", "op13_divergence"} == set(queries.ORACLES)
