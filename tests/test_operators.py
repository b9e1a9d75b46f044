"""Operators against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.functions import scalar as sc
from spanwise.functions import text as tx
from spanwise.operators import intervals, matching, metrics, models, reconcile, resample, rules, sampling, signal, tracks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sequential_match_takes_nearest_unused(spark):
    rng = random.Random(1)
    pred = [(g, round(rng.uniform(0, 50), 2)) for g in range(12) for _ in range(rng.randrange(0, 9))]
    true = [(g, round(rng.uniform(0, 50), 2)) for g in range(12) for _ in range(rng.randrange(0, 9))]
    got = {r.g: r for r in matching.match_at(frame(spark, pred, "g int, t double"), frame(spark, true, "g int, t double"), ["g"], "t", 3.0).collect()}
    for g in got:
        left, hits = sorted(t for k, t in true if k == g), 0
        for p in sorted(t for k, t in pred if k == g):
            near = min(left, key=lambda u: (abs(u - p), u), default=None)
            if near is not None and abs(near - p) <= 3.0:
                left.remove(near)
                hits += 1
        assert got[g].tp == hits


def test_suppression_matches_plain(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.uniform(0, 100), rng.choice([1.0, 2.0, 3.0])) for g in range(5) for i in range(40)]
    got = {(r.g, r.i) for r in signal.suppress(frame(spark, rows, "g int, i long, t double, s double"), ["g"], "t", "i", "s", 7.0).collect()}
    want = set()
    for g in range(5):
        kept = []
        for _, i, t, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1])):
            if all(abs(t - u) >= 7.0 for u in kept):
                kept.append(t)
                want.add((g, i))
    assert got == want


def test_nearest_and_tolerance_joins(spark):
    rng = random.Random(3)
    left = [(k % 3, k, rng.uniform(0, 30)) for k in range(40)]
    right = [(k % 4, k, rng.uniform(0, 30)) for k in range(40)]
    a, b = frame(spark, left, "g int, i int, t double"), frame(spark, right, "g int, j int, u double")
    near = {r.i: r.u_nearest for r in intervals.nearest(a, b, ["g"], "t", "u", ["i"], ["j"]).collect()}
    for g, i, t in left:
        want = min((u for h, _, u in right if h == g), key=lambda u: (abs(u - t), u), default=None)
        assert near[i] == want
    pairs = {(r.i, r.j) for r in intervals.tolerance_join(a, b, ["g"], "t", "u", 1.5).collect()}
    assert pairs == {(i, j) for g, i, t in left for h, j, u in right if g == h and abs(t - u) <= 1.5}
    outer = intervals.tolerance_join(a, b, ["g"], "t", "u", 0.001, "left")
    assert {r.i for r in outer.collect()} == {i for _, i, _ in left}


def test_containing_takes_first_by_start(spark):
    segs = [(1, 0, 0.0, 5.0), (1, 1, 5.0, 9.0), (1, 2, 4.0, 20.0), (2, 3, 0.0, 1.0)]
    pts = [(1, 0, 5.0), (1, 1, 4.5), (1, 2, 15.0), (1, 3, 30.0), (2, 4, 0.5)]
    got = intervals.containing(frame(spark, pts, "g int, i int, t double"), frame(spark, segs, "g int, seg int, s double, e double"), ["g"], "t", "s", "e", ["i"], ["seg"], 4.0)
    assert {r.i: r.seg for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: None, 4: 3}


@pytest.mark.parametrize("seed", range(3))
def test_auroc_with_ties_and_missing_scores(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0.1, 0.2, 0.5, 0.9, None, float("nan")]), rng.randrange(2)) for _ in range(80)]
    got = metrics.auroc(frame(spark, rows, "s double, y int"), [], "s", "y").first().auroc
    seen = [(s, y) for s, y in rows if s is not None and s == s]
    pos, neg = [s for s, y in seen if y], [s for s, y in seen if not y]
    assert got == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert metrics.auroc(frame(spark, [(0.5, 1)], "s double, y int"), [], "s", "y").first().auroc is None


def test_buffered_threshold(spark):
    rows = [(1 - k / 100, int(k not in (15, 30))) for k in range(60)]
    got = metrics.threshold_for(frame(spark, rows, "s double, y int"), "s", "y", 0.95, 10, buffer=1).first()
    best = max((n for n in range(10, 61) if sum(y for _, y in rows[:n]) / (n + 1) >= 0.95), default=None)
    assert got.selected == best


def test_upper_median_is_not_interpolated(spark):
    rows = [("a", x) for x in (4.0, 1.0, 3.0, 2.0)] + [("b", 5.0), ("b", 5.0), ("b", 7.0), ("b", None), (None, 9.0)]
    got = metrics.upper_median(frame(spark, rows, "k string, x double"), ["k"], "x").collect()
    assert {r.k: (r.n, r.upper_median) for r in got} == {"a": (4, 3.0), "b": (3, 5.0), None: (1, 9.0)}


def test_sums_over_ranges_are_those_of_one_order(spark):
    rng = np.random.default_rng(3)
    rows = [(float(np.round(rng.normal(), 2)) if i % 9 else 0.5, int(rng.random() < 0.4)) for i in range(3000)]
    for descending in (True, False):
        got = {r.s: (r.tp, r.n) for r in metrics.cumulative(frame(spark, rows, "s double, y int"), [], "s", "y", descending).collect()}
        for s in {s for s, _ in rows}:
            mine = [y for v, y in rows if (v >= s if descending else v <= s)]
            assert got[s] == (sum(mine), len(mine))
    assert metrics.cumulative(frame(spark, [], "s double, y int"), [], "s", "y").count() == 0


def test_rules_fail_closed(spark):
    fields = frame(spark, [(1, "yes", "no"), (2, None, "no"), (3, "no", "yes"), (4, "yes", None)], "id int, a string, b string")
    failing = rules.all_reasons(rules.checks({"require_yes": ["a"], "forbid_yes": ["b"], "forbid_insufficient": ["b"]}, ["a", "b"]))
    got = {r.id: r.f for r in fields.select("id", failing.alias("f")).collect()}
    assert got == {1: [], 2: ["require_yes:a"], 3: ["require_yes:a", "forbid_yes:b"], 4: ["forbid_insufficient:b"]}
    with pytest.raises(ValueError):
        rules.checks({"require_yes": ["zz"]}, ["a"])
    assert one(spark, rules.gate(F.lit(0.99), F.lit(None).cast("double"), F.lit(50), 10)) == "no_target"
    assert one(spark, sc.tri_state(F.lit("no"))) == "NOT_OBSERVABLE"


def test_consensus_first_seen_wins_ties(spark):
    votes = rules.consensus(F.array(F.lit("b"), F.lit("a"), F.lit(None), F.lit("a"), F.lit("b")))
    assert one(spark, votes[0]) == "b" and one(spark, votes[1]) == pytest.approx(0.4)


def test_text(spark):
    segs = "<seg><name>cut </name><span>0 to 2.5</span></seg><seg><name>peel</name><span>2.5 – 4</span></seg>"
    assert [tuple(x) for x in one(spark, tx.parsed_segments(F.lit(segs)))] == [("cut", 0.0, 2.5), ("peel", 2.5, 4.0)]
    assert [one(spark, tx.format_reward(F.lit(s))) for s in (f"<think>t</think><segments>{segs}</segments>", segs, "none")] == [1.0, 0.0, 0.0]
    assert one(spark, tx.reply_object(F.lit('Sure\n```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}'
    assert one(spark, tx.swap_word(F.lit("Pick the Cup, the cup"), "cup", "bowl")) == "Pick the Bowl, the cup"
    assert one(spark, tx.swap_word(F.lit("cupboard"), "cup", "bowl")) is None
    assert one(spark, tx.phrases(F.lit("put the cutting board on the board"), ["board", "cutting board"])) == ["cutting board", "board"]
    assert [one(spark, tx.atomicity(F.lit(s))) for s in ("stir again", "cut and peel", "cut", "cut the red apple")] == ["cycle", "compound", "terse", "atomic"]
    bad = one(spark, tx.parsed_actions(F.lit("take(cup); put(cup)[{slow}]; ??")))
    assert [tuple(a) for a in bad.actions] == [("take", "cup", ""), ("put", "cup", "slow")] and bad.bad == ["??"]


def test_recordings_stay_whole(spark):
    rows = frame(spark, [(i, f"r{i % 7}", i % 3 == 0) for i in range(100)], "id long, rec string, y boolean").withColumn("y", F.col("y").cast("int"))
    for folds in (sampling.grouped_folds(rows, "rec", 3), sampling.serpentine_folds(rows, "rec", "y", 3)):
        assert folds.count() == 7 and folds.select("fold").distinct().count() == 3
    reconcile.assert_disjoint(rows.where("rec < 'r3'"), rows.where("rec >= 'r3'"), "rec")
    with pytest.raises(ValueError):
        reconcile.assert_disjoint(rows, rows, "rec")
    with pytest.raises(ValueError):
        reconcile.excluded(rows, frame(spark, [("none",)], "rec string"), "rec")


def test_samples_keep_their_caps(spark):
    rows = frame(spark, [(i, f"r{i % 5}", i % 2) for i in range(200)], "id long, rec string, y int")
    taken = sampling.in_turn(rows, [("odd", F.col("y") == 1, 12), ("all", F.lit(True), 20)], "rec", "id", 5).toPandas()
    assert taken["id"].is_unique and taken.groupby("rec").size().max() <= 5
    assert (taken[taken["stratum"] == "odd"]["id"] % 2 == 1).all()


def test_derangement_moves_every_row(spark):
    rows = frame(spark, [(i, i % 4) for i in range(40)], "id long, rec int")
    got = resample.derangement(rows, "rec", "id").collect()
    assert all(r.rec != r.rec_partner for r in got) and sorted(r.id_partner for r in got) == list(range(40))
    with pytest.raises(ValueError):
        resample.derangement(rows.where("rec = 0 OR id = 1"), "rec", "id")


def test_permutations_keep_the_base_rate(spark):
    rows = frame(spark, [(i, int(i < 7)) for i in range(30)], "id long, y int")
    got = resample.permuted(rows, "id", "y", 5).groupBy("b").agg(F.sum("y_permuted").alias("n")).collect()
    assert [r.n for r in got] == [7] * 5


def plain_logistic(x, y, l2=1.0):
    """The minimum of the same objective by many small steps."""
    n, pos = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(20_000):
        err = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 0.5 * (x.T @ err / n + l2 / n * w), b - 0.5 * err.mean()
    return w, b


def test_out_of_fold_is_a_fit_on_the_other_folds(spark):
    rng = np.random.default_rng(5)
    x, fold = rng.normal(size=(90, 3)), np.arange(90) % 3
    y = (x[:, 0] + 0.7 * rng.normal(size=90) > 0).astype(float)
    x[::7, 1] = np.nan
    rows = [(i, int(fold[i]), int(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(90)]
    f = frame(spark, rows, "id long, fold int, y int, a double, b double, c double")
    got = {r.id: r.score for r in models.out_of_fold(f, "fold", "id", ["a", "b", "c"], "y", 3).collect()}
    for k in range(3):
        a, t = x[fold != k], y[fold != k]
        mean = np.nanmean(a, axis=0)
        filled = np.where(np.isnan(x), mean, x)
        spread = filled[fold != k].std(axis=0) + 1e-8
        w, b = plain_logistic((filled[fold != k] - mean) / spread, t)
        want = 1 / (1 + np.exp(-((filled[fold == k] - mean) / spread @ w + b)))
        assert np.allclose([got[i] for i in np.flatnonzero(fold == k)], want, atol=1e-5)


def test_nested_thresholds_come_from_inner_folds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, (i // 6) % 2, int(i % 2), float(i % 2 + 0.2 * rng.normal())) for i in range(240)]
    f = frame(spark, rows, "id long, fold int, inner int, y int, a double")
    got = models.nested(f, "fold", "inner", "id", ["a"], "y", 3, 2, 0.9).collect()
    assert len(got) == 3 and all(r.n == 80 and r.kept >= 30 and r.right >= 0.9 * r.kept for r in got)
    noise = models.nested(f.withColumn("a", F.rand(1)), "fold", "inner", "id", ["a"], "y", 3, 2, 0.99).collect()
    assert all(r.kept == 0 and r.threshold is None for r in noise)


def test_randomized_axes_are_those_of_the_whole(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 12)) * np.array([9, 5, 3] + [0.3] * 9)
    mean, v = models.randomized_pca(frame(spark, [(r.tolist(),) for r in x], "v array<double>"), "v", 3)
    want_mean, want = models.pca(x, 3)
    assert np.allclose(mean, want_mean) and np.allclose(np.abs(v @ want.T), np.eye(3), atol=1e-4)


def test_binomial_by_enumeration():
    from math import comb

    for n in (0, 1, 2, 7, 10, 31):
        p = [comb(n, i) / 2**n for i in range(n + 1)]
        for k in range(n + 1):
            assert models.binomial_two_sided(k, n) == pytest.approx(min(1.0, sum(q for q in p if q <= p[k] * (1 + 1e-9))))
    assert models.binomial_two_sided(499_000, 1_000_000) == pytest.approx(0.0457, abs=5e-4)


def test_nearest_without_replacement(spark):
    side = lambda rows: F.array(*[F.struct(F.lit(float(s)).alias("score"), F.lit(i).cast("long").alias("id")) for i, s in rows])
    left, right = [(1, 0.5), (2, 0.5), (3, 0.9), (4, 0.1)], [(10, 0.6), (11, 0.4), (12, 0.95)]
    got = [(p["left"], p["right"]) for p in one(spark, matching.nearest_without_replacement(side(left), side(right)))]
    free, want = dict(right), []
    for i, s in left:
        if free:
            best = min(free, key=lambda r: (round(abs(free[r] - s), 12), r))
            want.append((i, best))
            free.pop(best)
    assert got == want


def test_joint_rules_one_by_one(spark):
    base = dict(reset="OBSERVED_ABSENT", morphology="NO_TRANSITION", confidence=0.9, continuity="continuous", view="clear", nearby=5.0, left_supports_right=0.8, right_supports_left=0.8, same_label=False, only_turned=False)
    cases = [({}, "AUTO_REJECT_CANDIDATE", []), ({"reset": "OBSERVED_PRESENT", "only_turned": True}, "KEEP_BOUNDARY", []), ({"only_turned": True}, "REVIEW", ["direction_change_is_not_boundary"]), ({"reset": "NOT_OBSERVABLE"}, "REVIEW", ["unseen_reset_is_not_absent_reset"]), ({"view": "poor"}, "REVIEW", ["unobservable_is_not_no_boundary"]), ({"view": None}, "REVIEW", ["unobservable_is_not_no_boundary"]), ({"same_label": True, "right_supports_left": 0.1}, "REVIEW", ["same_label_is_not_same_instance"]), ({"nearby": 0.2}, "REVIEW", []), ({"nearby": None}, "AUTO_REJECT_CANDIDATE", []), ({"confidence": 0.1}, "REVIEW", []), ({"left_supports_right": None}, "REVIEW", [])]
    action, blocked = rules.joint_action({"strong": 0.4, "nearby": 1.0, "support": 0.3}, ["clear"])
    schema = "reset string, morphology string, confidence double, continuity string, view string, nearby double, left_supports_right double, right_supports_left double, same_label boolean, only_turned boolean"
    for change, want, hard in cases:
        row = base | change
        got = frame(spark, [tuple(row.values())], schema).select(action.alias("a"), blocked.alias("b")).first()
        assert (got.a, got.b) == (want, hard), change


def test_out_of_fold_scores_separate(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 4, int(i % 2), float(i % 2 + 0.3 * rng.normal()), float(rng.normal())) for i in range(120)]
    f = frame(spark, rows, "id long, fold int, y int, a double, b double")
    got = models.out_of_fold(f, "fold", "id", ["a", "b"], "y", 4).join(f, "id").toPandas()
    assert len(got) == 120 and got[got["y"] == 1]["score"].mean() > got[got["y"] == 0]["score"].mean() + 0.4
    few = models.out_of_fold(f.where("y = 1"), "fold", "id", ["a"], "y", 4)
    assert few.where("score IS NOT NULL").count() == 0


def test_small_models():
    assert models.binomial_two_sided(8, 10) == pytest.approx(0.109375)
    x = np.random.default_rng(1).normal(size=(60, 4))
    mean, v = models.pca(x, 2)
    want = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2].T
    assert np.allclose(np.abs(v @ want.T), np.eye(2), atol=1e-6) and np.allclose(mean, x.mean(axis=0))


def test_smoothing_keeps_parabolas():
    t = np.arange(12.0)
    assert np.allclose(tracks.savgol(t**2 - 3 * t), t**2 - 3 * t)


def test_tracks_follow_overlap(spark):
    rows = [(1, float(f), k, "a", 10.0 * k + f, 0.0, 10.0 * k + f + 8, 8.0) for f in range(5) for k in range(3)]
    rows.append((1, 20.0, 9, "a", 0.0, 0.0, 8.0, 8.0))
    got = tracks.track(frame(spark, rows, "rec int, t double, box_id long, label string, x0 double, y0 double, x1 double, y1 double"), "rec", "t", 2.0).toPandas()
    assert all(part["track"].nunique() == 1 for _, part in got[got["t"] < 9].groupby("box_id"))
    assert got[got["t"] == 20.0]["track"].iloc[0] == 3


def test_effective_rank(spark):
    rows = [(0, [float(i == j) for j in range(4)]) for i in range(4)] + [(1, [float(i), 0.0, 0.0, 0.0]) for i in range(5)]
    got = {r.k: r.effective_rank for r in models.effective_rank(frame(spark, rows, "k int, v array<double>"), "k", "v").collect()}
    assert got[0] == pytest.approx(3.0) and got[1] == pytest.approx(1.0)


def test_linked_groups(spark):
    from spanwise.operators import graph

    items = frame(spark, [(i,) for i in range(60)], "k long")
    links = frame(spark, [(i, i + 1) for i in range(40)] + [(50, 55)], "a long, b long")
    got = {r.k: r.root for r in graph.linked_groups(items, links, "k").collect()}
    assert got == {i: 0 if i <= 40 else 50 if i == 55 else i for i in range(60)}
