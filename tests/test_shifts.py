"""Shift nulls against replicates of rows in plain Python."""

import random

import pytest

from spanwise.operators import shifts


def plain(peaks, bounds, tol, replicates, own):
    """Hits of boundaries and of peaks by replicate, every peak moved and compared with every boundary."""
    out = {}
    keys = {k for k, *_ in peaks} | {k for k, *_ in bounds}
    for b in range(-1, replicates):
        near_b = near_p = 0
        for key in keys:
            times = [(t, i) for k, t, i in peaks if k == key]
            if not own:
                times = [(t, 0) for t in {t for t, _ in times}]  # equal times count once
            mine = [(lo, hi) for k, lo, hi in bounds if k == key]
            every = [t for t, _ in times] + [x for lh in mine for x in lh]
            lo, span = min(every), max(every) - min(every)
            if not span:
                continue
            moved = []
            for t, i in times:
                part = (b * 104729 + i * 7919) % 100003 / 100003.0 if own else (b * 104729 + key * 7919 + 1) % 100003 / 100003.0
                moved.append(t if b < 0 else lo + (t - lo + part * span) % span)
            far = lambda t, lh: 0 if lh[0] <= t <= lh[1] else lh[0] - t if t < lh[0] else t - lh[1]
            near_b += sum(any(far(t, lh) <= tol for t in moved) for lh in (mine if own else set(mine)))
            near_p += sum(any(far(t, lh) <= tol for lh in mine) for t in moved)
        out[b] = (near_b, near_p)
    return out


def tables(spark, seed, interval):
    rng = random.Random(seed)
    peaks, bounds = [], []
    for key, (n, m) in enumerate([(30, 12), (3, 40), (1, 1), (0, 5), (5, 0), (60, 60)]):
        peaks += [(key, rng.choice([rng.uniform(0, 300), float(rng.randrange(300))]), 1000 * key + i) for i in range(n)]
        for _ in range(m):
            u = rng.choice([rng.uniform(0, 300), float(rng.randrange(300))])
            bounds.append((key, u, u + rng.choice([0, 2.5, 9]) if interval else u))
    peaks += [(9, 5.0, 1), (9, 5.0, 2)]  # a recording without a span
    bounds += bounds[:3]
    ps = spark.createDataFrame(peaks + [(0, None, 1), (0, float("nan"), 2)], "rec long, t double, id long")
    return peaks, bounds, ps, spark.createDataFrame(bounds + [(0, None, None)], "rec long, u double, v double")


def spans(ps, bs):
    return shifts.spans_of(ps.where("NOT isnan(t)").select("rec", "t"), bs.select("rec", "u"), bs.select("rec", "v"))


@pytest.mark.parametrize("interval", [False, True])
@pytest.mark.parametrize("block", [4096, 7])
def test_circular_shifts(spark, monkeypatch, interval, block):
    monkeypatch.setattr(shifts, "BLOCK", block)
    peaks, bounds, ps, bs = tables(spark, 4 + interval, interval)
    want = plain(peaks, bounds, 1.5, 40, own=False)
    by_bound, by_peak = shifts.circular(ps, bs, spans(ps, bs), "rec", "t", ("u", "v") if interval else "u", 1.5, 40)
    by_bound, by_peak = by_bound.collect(), by_peak.collect()
    assert {r.b: r.hits for r in by_bound} == {b: x for b, (x, _) in want.items()}
    assert {r.b: r.hits for r in by_peak} == {b: y for b, (_, y) in want.items()}
    assert {r.n for r in by_peak} == {len({(k, t) for k, t, _ in peaks if k < 9} - {(k, t) for k, t, _ in peaks if k == 2 and len({t} | {u for q, u, v in bounds if q == 2}) == 1})}


@pytest.mark.parametrize("block", [4096, 7])
def test_a_shift_for_each_peak(spark, monkeypatch, block):
    monkeypatch.setattr(shifts, "BLOCK", block)
    peaks, bounds, ps, bs = tables(spark, 6, True)
    want = plain(peaks, bounds, 1.5, 30, own=True)
    got = shifts.own_shifts(ps, bs, spans(ps, bs), "rec", "t", "id", ("u", "v"), 1.5, 30).collect()
    assert {r.b: r.hits for r in got} == {b: x for b, (x, _) in want.items()}


def test_shifts_of_nothing(spark):
    _, _, ps, bs = tables(spark, 1, False)
    for p, b in ((ps.limit(0), bs), (ps, bs.limit(0)), (ps.limit(0), bs.limit(0))):
        for table in (*shifts.circular(p, b, spans(ps, bs), "rec", "t", "u", 1.0, 5), shifts.own_shifts(p, b, spans(ps, bs), "rec", "t", "id", "u", 1.0, 5)):
            assert [r.hits for r in table.collect()] == [0] * 6
