"""Refits under corrected and randomly flipped labels against a plain version."""

import numpy as np
import pytest

from spanwise.operators import relabel

FEATURES = ["f0", "f1", "f2"]


def scattered(b, j):
    return (j % 1_000_003 * ((b * 7919 + 104_729) % 1_000_003) + (j % 10_007) ** 2 * (b + 17)) % 1_000_003


def plain_model(x, y, least):
    """Weights of a balanced ridge logistic regression by gradient steps from scipy-free Newton on the whole matrix."""
    n = len(y)
    if n < least or len(set(y)) < 2:
        return None
    mean = np.nanmean(x, axis=0)
    z = np.where(np.isnan(x), mean, x)
    spread = z.std(axis=0) + 1e-8
    z = np.column_stack([(z - mean) / spread, np.ones(n)])
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    penalty = np.diag([1.0 / n] * x.shape[1] + [0.0])
    w = np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) / n + penalty + 1e-12 * np.eye(len(w)), z.T @ (weight * (p - y)) / n + penalty @ w)
    return mean, spread, w


def plain_scores(x, y, fold, least):
    out = np.full(len(y), np.nan)
    for f in set(fold):
        model = plain_model(x[fold != f], y[fold != f], least)
        if model is not None:
            mean, spread, w = model
            z = (np.where(np.isnan(x[fold == f]), mean, x[fold == f]) - mean) / spread
            out[fold == f] = 1 / (1 + np.exp(-(np.column_stack([z, np.ones(len(z))]) @ w)))
    return out


def plain_auroc(s, y):
    keep = ~np.isnan(s)
    pos, neg = s[keep & (y == 1)], s[keep & (y == 0)]
    if not len(pos) or not len(neg):
        return None
    return float(((pos[:, None] - neg > 1e-9) + 0.5 * (np.abs(pos[:, None] - neg) <= 1e-9)).mean())


def made(seed, n=260):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) > 0.4).astype(int)
    c = np.where(rng.random(n) < 0.12, 1 - y, y)
    x[rng.random((n, 3)) < 0.05] = np.nan
    x[n // 2 : n // 2 + 30] = x[0]  # rows that repeat
    ids = rng.choice(10**9, n, replace=False)
    return x, y, c, rng.integers(0, 4, n), ids


def test_impact_matches_plain_refits(spark):
    x, y, c, fold, ids = made(5)
    rows = [(int(i), int(f), *(None if np.isnan(v) else float(v) for v in r), int(a), int(b)) for i, f, r, a, b in zip(ids, fold, x, y, c)]
    rows += [(1, 0, 1.0, 1.0, 1.0, None, 1), (2, 0, 1.0, 1.0, 1.0, 1, None)]  # without one of the labels
    frame = spark.createDataFrame(rows, "id long, fold int, f0 double, f1 double, f2 double, y int, c int").repartition(5)
    impacts = relabel.impact(frame, "id", "fold", FEATURES, "y", "c", 4, 6)
    got = {r.b: r for r in impacts.collect()}
    changed = int((y != c).sum())
    labels = {-2: y, -1: c}
    for b in range(6):
        order = sorted(range(len(ids)), key=lambda k: (scattered(b, int(ids[k])), ids[k]))[:changed]
        labels[b] = y.copy()
        labels[b][order] = 1 - y[order]
    assert sorted(got) == sorted(labels)
    for b, own in labels.items():
        score = plain_scores(x, own, fold, 10)
        assert got[b].n == len(y) and got[b].positives == own.sum()
        assert got[b].auroc == pytest.approx(plain_auroc(score, own), abs=1e-6)
        assert got[b].unchanged == pytest.approx(plain_auroc(score[y == c], y[y == c]), abs=1e-6)
    told = relabel.verdict(impacts).first()
    moved = np.array([got[b].auroc - got[-2].auroc for b in range(6)])
    assert told.draws == 6 and told.delta == pytest.approx(got[-1].auroc - got[-2].auroc) and told.p == pytest.approx((moved >= told.delta).mean())
    assert told.null_mean == pytest.approx(moved.mean()) and told.unchanged_delta == pytest.approx(got[-1].unchanged - got[-2].unchanged)


def test_full_populations_and_unusable_folds(spark):
    x, y, c, fold, ids = made(8, 60)
    y[fold != 2] = 0  # outside fold 2 one class only: this fold is not scored
    y[:1] = y[:1]
    frame = spark.createDataFrame([(int(i), int(f), *map(float, np.nan_to_num(r)), int(a)) for i, f, r, a in zip(ids, fold, x, y)], "id long, fold int, f0 double, f1 double, f2 double, y int")
    got = relabel.full_population(frame, "id", "fold", FEATURES, "y", 4).collect()
    score = plain_scores(np.nan_to_num(x), y, fold, 10)
    assert [r.n for r in got] == [int((~np.isnan(score)).sum())] and np.isnan(score[fold == 2]).all()
    want = plain_auroc(score, y)
    assert got[0].auroc == (want if want is None else pytest.approx(want, abs=1e-6))
    assert relabel.full_population(frame.limit(0), "id", "fold", FEATURES, "y", 4).count() == 0
