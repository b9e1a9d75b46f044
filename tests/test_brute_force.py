"""Queries that SQL does not express, against plain versions on the smallest tables."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import resample
from spanwise.plans import registry
from spanwise.plans.base import GAP, TOL, scored, truth
from spanwise.plans.temporal import peaks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def texts(spark, table="benchmark"):
    return {r.item_id: r.text for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()}


def test_longest_phrases_first(spark):
    phrases = ["of the", "on the", "the", "in", "and", "of"]
    got = {r.item_id: r.phrases for r in rows(spark, "f04_longest_phrase_first")}
    for k, text in texts(spark).items():
        rest, want = text.lower(), []
        for p in sorted(["of the", "the", "in", "on the", "and", "of"], key=lambda p: -len(p.split())):
            if re.search(rf"(^|[^a-z]){p}([^a-z]|$)", rest):
                want.append(p)
                rest = re.sub(rf"(^|[^a-z]){p}([^a-z]|$)", r"\1 \2", rest)
        assert sorted(got[k]) == sorted(want) and set(want) <= set(phrases)


def test_counterfactuals(spark):
    got = {}
    for r in rows(spark, "f12_counterfactuals"):
        got.setdefault(r.item_id, {})[r.kind] = (r.text, r.well_formed)
    for k, text in texts(spark).items():
        clauses = [c for c in re.split(r"\s*(?:,|;|\band then\b|\bthen\b|\band\b)\s*", text.strip(), flags=re.ASCII) if c.strip()]
        want = {"add_claim": f"{text}, this from"}
        if "the" in text:
            want["wrong_verb"] = text.replace("the", "this")
        if "of" in text:
            want["wrong_object"] = text.replace("of", "from")
        if len(clauses) > 1:
            want |= {"drop_claim": ", ".join(clauses[:-1]), "reorder": ", ".join(clauses[::-1])}
        want = {kind: t for kind, t in want.items() if t != text}
        assert {kind: t for kind, (t, _) in got[k].items()} == want
        for t, ok in got[k].values():
            low = t.strip().lower()
            doubled = re.search(r"\b(\w+) \1\b", low, flags=re.ASCII)
            assert ok == (not doubled and not re.search("^(and|then|,)|(and|then|,)$", low) and len(re.findall("[a-z]+", low)) >= 2)


def auroc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def slot(b, j, n):
    def scattered(b, j):
        return (j % 1_000_003 * ((b * 7919 + 104_729) % 1_000_003) + (j % 10_007) ** 2 * (b + 17)) % 1_000_003

    return (scattered(b, j) * 1_000_003 + scattered(b + 101, j + 7)) % n


@pytest.mark.parametrize("n", [1, 7, 20, 500])
def test_draws_are_with_replacement(spark, n):
    """As many as there are, of which a share of about 1 - 1/e is distinct, and not the same in every replicate."""
    drawn = {r.rec: r.drawn for r in resample.draws(spark.range(n).withColumnRenamed("id", "rec"), "rec", 60).collect()}
    assert {k: sorted(v) for k, v in drawn.items()} == {k: sorted(b for b in range(60) for j in range(n) if slot(b, j, n) == k) for k in range(n)}
    share = np.mean([sum(b in v for v in drawn.values()) / n for b in range(60)])
    assert abs(share - (1 - (1 - 1 / n) ** n)) < 0.06
    assert len({tuple(sorted(k for k, v in drawn.items() for x in v if x == b)) for b in range(60)}) > (50 if n > 7 else 0)


def plain_pr_auc(s, y):
    points, tp, n = [(0.0, 1.0)], 0, 0
    for v in sorted(set(s), reverse=True):
        tp, n = tp + int(y[s == v].sum()), n + int((s == v).sum())
        points.append((tp / max(1, y.sum()), tp / n))
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


def test_bootstrapped_curves_and_own_metrics(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rec = rng.choice(12, 300, p=[0.4] + [0.6 / 11] * 11)
    y = rng.integers(0, 2, 300)
    score = np.round(rng.normal(size=300) + y * 0.7, 1)
    data = [(int(r) if r != 3 else None, float(v), int(t)) for r, v, t in zip(rec, score, y)] + [(1, None, 1), (1, float("nan"), 0)]
    frame = spark.createDataFrame(data, "rec long, s double, y int").repartition(6)
    monkeypatch.setattr(resample, "ROWS", 16)
    got = {r.b: r for r in resample.bootstrap_curves(frame, "rec", "s", "y", 25).collect()}
    own = {r.b: r for r in resample.bootstrap(frame, "rec", {"k": F.col("y"), "n": F.lit(1).cast("long")}, {"rate": F.col("k") / F.col("n"), "n": F.col("n")}, 25).collect()}
    names = [3, *[k for k in range(12) if k != 3]]  # null is first
    assert sorted(got) == sorted(own) == list(range(-1, 25))
    for b in got:
        drawn = [names[slot(b, j, 12)] for j in range(12)] if b >= 0 else names
        part = np.concatenate([np.flatnonzero(rec == k) for k in drawn])
        assert got[b].auroc == pytest.approx(auroc(score[part], y[part])) and got[b].pr_auc == pytest.approx(plain_pr_auc(score[part], y[part]))
        ones = drawn.count(1)
        assert own[b].n == len(part) + 2 * ones and own[b].rate == pytest.approx((y[part].sum() + ones) / own[b].n)
    one_class = {r.b: (r.auroc, r.pr_auc) for r in resample.bootstrap_curves(frame.where("y = 0"), "rec", "s", "y", 3).collect()}
    assert one_class == {b: (None, None) for b in range(-1, 3)}


def test_candidate_suite_of_a_few_items(spark):
    from spanwise.operators import candidates as cs

    rows = [
        (1, 1, "a", 0.9, 1), (1, 1, "b", 0.8, 0), (1, 1, "c", 0.1, 1),  # one hit, one false, one missed
        (1, 2, "a", 0.2, 0), (1, 2, "b", 0.1, 0),  # atomic and empty
        (2, 3, "a", 0.7, 0), (2, 3, "b", None, 0),  # atomic, one false
        (2, 4, "a", 0.6, 0), (2, 4, "b", 0.9, 1),  # exact but for a false one at 0.6
        (2, 5, "a", 0.5, 0), (2, 5, "b", 0.5, 1),  # a tie at the threshold: nothing is taken
    ]
    frame = spark.createDataFrame(rows, "rec long, item long, label string, s double, y int")
    items = cs.by_item(frame, ["rec", "item"], "s", "y", "label", F.lit(0.5))
    got = items.agg(*[F.sum(c).alias(c) for c in cs.SUMS]).select(*[c.alias(n) for n, c in cs.suite().items()]).first().asDict()
    want = {"precision": 2 / 5, "recall": 2 / 4, "f1": 4 / 9, "empty_accuracy": 1 / 2, "fp_per_atomic": 1 / 2, "exact": 1 / 5, "compound_exact": 0.0, "cardinality_mae": 3 / 5, "recall_at_1": 2 / 3, "recall_at_2": 1.0, "recall_at_3": 1.0}
    assert got == pytest.approx(want)


def test_paired_bootstrap_of_auroc(spark):
    data = scored(spark, SF).toPandas()
    names = sorted(data["source"].unique(), key=lambda x: (x is not None, x))
    got = {r.b: r.delta for r in rows(spark, "b03_paired_auroc_delta")}
    n = len(names)
    for b in list(got)[:12]:
        drawn = [names[slot(b, j, n)] for j in range(n)]
        part = np.concatenate([np.flatnonzero((data["source"] == d).to_numpy()) for d in drawn])
        y = data["y"].to_numpy()[part]
        if len(set(y)) < 2:
            assert got[b] is None
            continue
        want = auroc(data["s2"].to_numpy()[part], y) - auroc(data["s"].to_numpy()[part], y)
        assert got[b] == pytest.approx(want, abs=2e-6)


def test_sequential_match(spark):
    decoded, purchases = {}, {}
    for r in peaks(spark, SF).where("prob >= 35").collect():
        decoded.setdefault(r.user_id, []).append((-r.prob, r.i, r.t))
    for r in truth(spark, SF).collect():
        purchases.setdefault(r.user_id, []).append(r.u)
    got = {r.user_id: (r.n_pred, r.n_gt, r.tp) for r in rows(spark, "j16_sequential_match")}
    for user in set(decoded) | set(purchases):
        kept = []
        for _, _, t in sorted(decoded.get(user, [])):
            if all(abs(t - q) >= GAP for q in kept):
                kept.append(t)
        left, hits = sorted(purchases.get(user, [])), 0
        for t in sorted(kept):
            near = min(left, key=lambda u: (abs(u - t), u), default=None)
            if near is not None and abs(near - t) <= TOL:
                left.remove(near)
                hits += 1
        assert got[user] == (len(kept), len(purchases.get(user, [])), hits)


def test_nearest_without_replacement(spark):
    data = [r for r in scored(spark, SF).collect() if r.s >= 0.4 and r.lang == "en"]
    got = {}
    for r in rows(spark, "j21_nearest_without_replacement"):
        got.setdefault(r.source, {})[r.left] = r.right
    for source in {r.source for r in data}:
        mine = sorted((r for r in data if r.source == source), key=lambda r: r.doc_id)
        free, want = {r.doc_id: r.s2 for r in mine if r.y == 1}, {}
        for r in mine:
            if r.y == 0 and free:
                best = min(free, key=lambda k: (abs(free[k] - r.s2), k))
                want[r.doc_id] = best
                free.pop(best)
        assert got.get(source, {}) == want


def test_leave_one_recording_out(spark):
    data = scored(spark, SF).toPandas()
    got = {r.doc_id: (r.fold, r.score) for r in rows(spark, "m03_leave_one_recording_out")}
    assert len(got) == len(data)
    x = data[["s", "s2", "z"]].to_numpy(float)
    y, source = data["y"].to_numpy(float), data["source"].to_numpy()
    name = sorted(set(source))[0]
    train = source != name
    mean, spread = x[train].mean(axis=0), x[train].std(axis=0) + 1e-8
    z, n, pos = (x - mean) / spread, train.sum(), y[train].sum()
    weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    w, b = np.zeros(3), 0.0
    for _ in range(30_000):
        err = (weight * (1 / (1 + np.exp(-(z @ w + b))) - y))[train]
        w, b = w - 0.5 * (z[train].T @ err / n + w / n), b - 0.5 * err.mean()
    for k in np.flatnonzero(~train)[:40]:
        assert got[data["doc_id"][k]][1] == pytest.approx(1 / (1 + np.exp(-(z[k] @ w + b))), abs=2e-4)


def test_clause_decomposition(spark):
    """Clauses in order, each with its first verb and last word, or the object of a clause before it."""
    from spanwise.plans.language import VERBS

    want = {}
    for item, text in texts(spark).items():
        thing, no = None, 0
        parts = [c for c in re.split(r"\s*(?:,|;|\band then\b|\bthen\b|\band\b)\s*", text.strip(" ")) if c.strip(" ")]
        for clause in parts:
            found = re.findall("[a-z]+", clause.lower())
            thing = found[-1] if found else thing
            want[item, no] = (clause, next((VERBS[w] for w in found if w in VERBS), None), thing)
            no += 1
    got = {(r.item_id, r.clause_no): (r.clause, r.verb, r.object) for r in rows(spark, "f10_clause_decomposition")}
    assert got == want and len({k for k, _ in want}) < len(want)


def test_strata_in_turn(spark):
    """Each stratum takes by draw what the ones before left, at most five of a source in all."""
    data = [(r.doc_id, r.source, r.y, r.z) for r in scored(spark, SF).collect()]
    draw = lambda d: (d * 7919 % 1009, d)
    taken, used = {}, {}
    for name, test, n in (("toxic", lambda r: r[3] == 1, 15), ("bad", lambda r: r[2] == 0, 15), ("rest", lambda r: True, 30)):
        left, depth = [], dict(used)
        for r in sorted((r for r in data if test(r) and r[0] not in taken), key=lambda r: draw(r[0])):
            depth[r[1]] = depth.get(r[1], 0) + 1
            if depth[r[1]] <= 5:
                left.append(r)
        for r in left[:n]:
            taken[r[0]] = name
            used[r[1]] = used.get(r[1], 0) + 1
    assert {r.doc_id: r.stratum for r in rows(spark, "l05_sequential_strata")} == taken and set(taken.values()) == {"toxic", "bad", "rest"}


def test_grouped_folds_deal_groups_in_order_of_their_hash(spark):
    import zlib

    names = {r.source for r in scored(spark, SF).collect()}
    order = sorted(names, key=lambda s: (zlib.crc32(s.encode()), s))
    assert {r.source: r.fold for r in rows(spark, "l09_grouped_folds")} == {s: k % 5 for k, s in enumerate(order)}


def test_trajectory_features_of_known_paths(spark):
    """A line, a swing of eight turns, a run with two stops, and a path too short."""
    from spanwise.operators import tracks

    paths = {1: [(float(i), 0.5 * i) for i in range(40)], 2: [(float(np.sin(2 * np.pi * i / 10)), 0.01 * i) for i in range(41)], 4: [(1.0, 1.0)] * 5}
    x, stops = 0.0, []
    for i in range(40):
        x += 0.0 if 10 <= i < 14 or 25 <= i < 28 else 1.0
        stops.append((x, 0.0))
    paths[3] = stops
    frame = spark.createDataFrame([(k, float(i), *p) for k, path in paths.items() for i, p in enumerate(path)], "rec long, t double, x double, y double")
    got = {r.rec: r for r in tracks.trajectory_features(frame, "rec", "t", "x", "y").collect()}
    assert (got[1].reversals, got[1].stops) == (0, 0) and got[1].straightness == pytest.approx(1.0)
    assert got[2].reversals == 8 and got[2].straightness < 0.1 and got[2].periodicity > 0.5 and got[2].band > 0.8
    assert got[3].stops == 2 and got[3].reversals == 0 and got[3].straightness == pytest.approx(1.0)
    assert (got[4].n, got[4].reversals, got[4].straightness, got[4].periodicity) == (5, 0, None, None)
    assert got[2].periodicity > got[3].periodicity
