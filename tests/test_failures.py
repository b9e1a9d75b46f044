"""The failure audit against a plain version."""

import random
import statistics
from collections import Counter

import pytest

from spanwise.operators import failures


def plain(peaks, segments, tol):
    bounds, missed, false = [], [], []
    for rec in sorted({k for k, *_ in segments}):
        mine = sorted((s, e, label) for k, label, s, e in segments if k == rec)
        gts = []
        for (_, e, label), (s, _, after) in zip(mine, mine[1:]):
            gts.append((s, label if round(e, 2) == round(s, 2) else "?", after))
        own = sorted(t for k, t, _ in peaks if k == rec)
        left = sorted(g[0] for g in gts)
        for t in own:
            near = min(left, key=lambda u: (abs(u - t), u), default=None)
            if near is not None and abs(near - t) <= tol:
                left.remove(near)
        left = Counter(left)
        for u, before, after in sorted(gts, key=lambda g: (g[0], g[1], g[2]), reverse=True):
            lost = left[u] > 0
            left[u] -= lost
            bounds.append((rec, u, "same" if before == after else "diff", lost))
            missed += [bounds[-1]] if lost else []
        for t in own:
            if all(abs(t - g[0]) > tol for g in gts):
                held = next(((s, e) for s, e, _ in mine if s <= t <= e), None)
                false.append((rec, t, None if held is None else (t - held[0]) / max(held[1] - held[0], 1e-6)))
    return bounds, missed, false


def shown(rows):
    out, per = [], Counter()
    for rec, t in sorted(rows):
        if per[rec] < 2 and len(out) < 12:
            out.append((str(rec), t))
            per[rec] += 1
    return out


def test_audit_matches_a_plain_count(spark):
    rng = random.Random(8)
    peaks, segments = [], []
    for rec in range(12):
        t = 0.0
        for _ in range(rng.randrange(1, 25)):
            e = t + rng.choice([0.5, 3.0, 7.25])
            segments.append((rec, rng.choice("aab"), t, e))
            t = e + (rng.choice([0.001, 1.5]) if rng.random() < 0.3 else 0.0)
        peaks += [(rec, round(rng.uniform(0, t + 3), 2), 100 * rec + i) for i in range(rng.randrange(20))]
    tables = spark.createDataFrame(peaks, "rec long, t double, i long"), spark.createDataFrame(segments, "rec long, label string, s double, e double")
    got = {}
    for r in failures.audit(*tables, "rec", "t", "i", 0.5, 4.0).collect():
        got.setdefault(r.part, []).append((r.name, r.n, r.of, r.value))
    bounds, missed, false = plain(peaks, segments, 0.5)
    kinds = {k: [b[3] for b in bounds if b[2] == k] for k in ("same", "diff")}
    assert {r[0]: r[1:] for r in got["rate"]} == {k: (sum(v), len(v), pytest.approx(sum(v) / len(v))) for k, v in kinds.items()}
    place = [p for *_, p in false if p is not None]
    edge = sum(p < 0.15 or p > 0.85 for p in place)
    assert {r[0]: r[1:] for r in got["position"]} == {"mean": (len(place), len(place), pytest.approx(statistics.mean(place))), "median": (len(place), len(place), pytest.approx(statistics.median(place))), "edge": (edge, len(place), pytest.approx(edge / len(place)))}
    for part, rows in (("missed_top", missed), ("false_top", false)):
        most = sorted(Counter(r[0] for r in rows).items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(r[:3] for r in got[part]) == sorted((str(k), n, len(rows)) for k, n in most)
    for part, rows in (("missed_same", [m[:2] for m in missed if m[2] == "same"]), ("missed_diff", [m[:2] for m in missed if m[2] == "diff"]), ("false", [f[:2] for f in false])):
        assert sorted((r[0], r[3]) for r in got[part]) == sorted(shown(rows))


def test_audit_of_nothing(spark):
    peaks, segments = spark.createDataFrame([], "rec long, t double, i long"), spark.createDataFrame([], "rec long, label string, s double, e double")
    assert all(not r.n for r in failures.audit(peaks, segments, "rec", "t", "i", 0.5, 4.0).collect())
