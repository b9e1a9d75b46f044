"""Exact links in groups of near copies, and the near-dedup stage on clusters around its threshold."""

import random

import numpy as np
import pytest

from spanwise.llm import mixing, resolve, similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        a, b = sorted((root[a], root[b]))
        root = [a if r == b else r for r in root]
    return root


def packed(sets):
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.array([x for s in sets for x in sorted(s)], np.uint64), bounds


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def some_sets(rng, n, base, changed):
    """Sets around a few others, some empty, some equal."""
    bases = [set(rng.sample(range(10_000), rng.randrange(1, base))) for _ in range(4)]
    sets = []
    for _ in range(n):
        s = set(rng.choice(bases))
        for x in list(s):
            if rng.random() < changed:
                s.discard(x)
                s.add(rng.randrange(10_000, 20_000))
        sets.append(s)
    return sets + [set(), set(), {1}, {1}, {1, 2, 3, 4}, {1, 2, 3, 4, 5}]


@pytest.mark.parametrize("seed", range(12))
def test_links_connect_what_all_pairs_connect(seed):
    rng = random.Random(seed)
    sets = some_sets(rng, rng.choice([1, 40, 90]), rng.choice([4, 30, 120]), rng.choice([0.01, 0.05, 0.08, 0.12]))
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    found = resolve.links(*packed(sets), 0.8)
    assert set(tuple(sorted(p, reverse=True)) for p in found) <= set(pairs)
    assert components(n, found) == components(n, pairs)
    known = [rng.randrange(n // 4 + 1) for _ in range(n)]  # some are connected already
    before = [(i, known.index(known[i])) for i in range(n)]
    more = resolve.links(*packed(sets), 0.8, np.array(known))
    assert components(n, before + more) == components(n, before + pairs)


@pytest.mark.parametrize("members", [7, 30, 2048])
def test_blocks_do_not_change_groups(spark, monkeypatch, members):
    rng = random.Random(3)
    rows, want = [], []
    for group in range(3):
        sets = some_sets(rng, (200, 60, 5)[group], 60, (0.02, 0.05, 0.3)[group])
        n = len(want)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
        want += [n + r for r in components(len(sets), pairs)]
        rows += [(group, n + i, np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)]
    monkeypatch.setattr(resolve, "MOST_MEMBERS", members)
    got = {r.node: r.component for r in resolve.resolved(spark.createDataFrame(rows, "component long, text_key long, held binary"), 0.8).collect()}
    assert [got.get(i, i) for i in range(len(want))] == want


def shingled(text):
    words = text.split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


@pytest.mark.parametrize("changed", [(1, 2, 2), (0, 1, 2, 3)])
def test_clusters_at_the_threshold(spark, monkeypatch, changed):
    """Of 120 words one to three are replaced in each text: many of its 20 fellows are a little under 0.8, others a little over."""
    rng = random.Random(9)
    words = ["w%d" % i for i in range(4000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(20):
            copy = list(base)
            for k in rng.sample(range(120), rng.choice(changed)):
                copy[k] = rng.choice(words)
            texts.append(" ".join(copy))
    sets = [shingled(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if i // 20 == j // 20 and jaccard(sets[i], sets[j]) >= 0.8]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)

    def groups():
        ids, label = similar.groups(docs)
        rows = ids.join(label, "text_key", "left").collect()
        return {r.doc_id: r.label if r.label is not None else r.text_key for r in rows}

    got = groups()
    together = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 100 and together >= 0.97 * len(pairs)
    whole = components(len(sets), pairs)
    assert not any(got[i] == got[j] and whole[i] != whole[j] for i in range(len(sets)) for j in range(i))
    for name, value in (("MOST_ROWS", 20), ("SMALL", 8)):
        monkeypatch.setattr(similar, name, value)
    monkeypatch.setattr(resolve, "MOST_MEMBERS", 6)
    assert groups() == got


@pytest.mark.parametrize("limits", [{"budget": 30.0}, {"budget": 70.0}, {"most_repeats": 2.0}, {"entropy": 0.9, "budget": 200.0}, {"budget": 1.0}])
def test_mixed_emits_what_the_schedule_lists(spark, limits):
    docs = [(i, f"w{i} two three four five", "en", "ab"[i % 2], 0) for i in range(20)] + [(50 + i, "word " * (i + 1), "en", "c", 0) for i in range(9)] + [(90, None, "en", "empty", 0)]
    frame = spark.createDataFrame(docs, DOCS)

    def times(rows):
        out = {}
        for r in rows.select("doc_id").collect():
            out[r.doc_id] = out.get(r.doc_id, 0) + 1
        return out

    assert times(mixing.mixed(frame, **limits)) == times(mixing.schedule(frame, **limits))
