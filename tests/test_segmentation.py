"""Segment metrics, rewards and the completion grammar on random recordings, against plain versions of their definitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanwise.functions import text as tx
from spanwise.operators import segmentation

COLUMNS = ("n_pred", "n_gt", "f1_30", "f1_50", "f1_70", "mean_iou", "boundary", "coverage", "overlap", "count_acc", "iou_reward", "seq_reward")


def pairs_of(pred, true):
    """Greedy one-to-one pairs over an IoU of 0.1, the largest first; of equal ones that with the later prediction, then truth."""
    every = []
    for p, (s, e) in enumerate(pred):
        for g, (gs, ge) in enumerate(true):
            hull = max(e, ge) - min(s, gs)
            iou = max(0.0, min(e, ge) - max(s, gs)) / hull if hull > 0 else 0.0
            if round(iou, 9) > 0.1:
                every.append((round(iou, 9), p, g))
    taken_p, taken_g, out = set(), set(), []
    for iou, p, g in sorted(every, reverse=True):
        if p not in taken_p and g not in taken_g:
            taken_p.add(p)
            taken_g.add(g)
            out.append((p, g, iou))
    return out


def plain(pred, true, length):
    """All scores of a recording."""
    if not pred or not true:
        return dict.fromkeys(COLUMNS, 0.0) | {"n_pred": len(pred), "n_gt": len(true)}
    pairs = pairs_of(pred, true)
    worth = sum(iou * max(0.0, (1 - abs(true[g][0] - pred[p][0]) / length) * (1 - abs(true[g][1] - pred[p][1]) / length)) for p, g, iou in pairs)
    lo, hi = min(a for a, _ in true), max(b for _, b in true)
    inside = sorted((max(a, lo), min(b, hi)) for a, b in pred if min(b, hi) > max(a, lo))
    covered, upto = 0.0, lo
    for a, b in inside:
        covered += max(0.0, b - max(a, upto))
        upto = max(upto, b)
    ordered = sorted(pred)
    shared = sum(max(0.0, a[1] - b[0]) for a, b in zip(ordered, ordered[1:]))
    total = sum(b - a for a, b in pred)
    out = {"n_pred": len(pred), "n_gt": len(true), "mean_iou": sum(x for *_, x in pairs) / len(pairs) if pairs else 0.0, "boundary": worth / len(true), "iou_reward": worth / max(len(pred), len(true))}
    for level in (0.3, 0.5, 0.7):
        out[f"f1_{level * 100:.0f}"] = 2 * sum(x >= level for *_, x in pairs) / (len(pred) + len(true))
    out["coverage"] = min(1.0, covered / max(hi - lo, 1e-6))
    out["overlap"] = min(1.0, shared / (total or 1e-6))
    out["count_acc"] = max(0.0, 1 - abs(len(pred) - len(true)) / len(true))
    out["seq_reward"] = 0.4 * out["coverage"] + 0.3 * (1 - out["overlap"]) + 0.3 * out["count_acc"]
    return out


def cut_up(rng, length, n):
    """``n`` segments of a recording, with gaps and sometimes overlaps; times are quarters, so that ties occur."""
    out = []
    for _ in range(n):
        a = rng.randrange(0, int(length * 4) - 4) / 4
        out.append((a, min(length, a + rng.randrange(1, 60) / 4)))
    return out


def recordings(seed, n=60):
    rng = random.Random(seed)
    for rec in range(n):
        length = rng.choice([8.0, 31.5, 120.0])
        true = cut_up(rng, length, rng.choice([0, 1, 3, 7]))
        kind = rng.randrange(4)
        if kind == 0:  # shaken truths
            pred = [(max(0.0, a + rng.choice([-0.5, 0, 0.25])), min(length, b + rng.choice([-0.25, 0, 0.5]))) for a, b in true if rng.random() < 0.8]
            pred = [(a, b) for a, b in pred if b > a]
        elif kind == 1:
            pred = list(true)
        else:
            pred = cut_up(rng, length, rng.choice([0, 2, 9]))
        yield rec, length, pred, true


@pytest.fixture(scope="module")
def made(spark):
    every = list(recordings(11))
    pred = spark.createDataFrame([(r, p, *x) for r, _, pred, _ in every for p, x in enumerate(pred)], "rec long, p long, s double, e double")
    true = spark.createDataFrame([(r, g, *x) for r, _, _, true in every for g, x in enumerate(true)], "rec long, g long, gs double, ge double")
    length = spark.createDataFrame([(r, x) for r, x, *_ in every], "rec long, duration double")
    return every, pred, true, length


def test_metrics_of_random_recordings(made):
    every, pred, true, length = made
    got = {r.rec: r.asDict() for r in segmentation.metrics(pred, true, ["rec"], length).collect()}
    want = {r: plain(p, t, x) for r, x, p, t in every if p or t}
    assert got.keys() == want.keys()
    for rec, values in want.items():
        assert {c: got[rec][c] for c in COLUMNS} == pytest.approx(values, abs=1e-9), rec


def test_matches_of_random_recordings(made):
    every, pred, true, _ = made
    got = {(r.rec, r.p, r.g) for r in segmentation.matched(pred, true, ["rec"]).collect()}
    assert got == {(r, p, g) for r, _, ps, ts in every for p, g, _ in pairs_of(ps, ts)}


def test_what_the_rewards_are_for(made):
    """Truths repeated score highest, fewer or more segments less, and order among equals does not matter."""
    every, *_ = made
    for _, length, _, true in every:
        if len(true) < 3 or len(set(true)) < len(true):
            continue
        best = plain(true, true, length)
        assert plain(true[1:], true, length)["iou_reward"] < best["iou_reward"]
        assert plain([*true, (0.0, 0.25), (0.25, 0.5)], true, length)["iou_reward"] < best["iou_reward"] <= 1 + 1e-9


WORDS = ["stir", "the pot", "pour water", "fold", "a sheet"]


def plain_name(pred, true, labels_p, labels_t, alike, weight):
    pairs = pairs_of(pred, true)
    gained = 0.0
    for p, g, _ in pairs:
        others = [alike(labels_p[p], labels_t[o]) for o in range(len(true)) if o != g]
        gained += max(0.0, alike(labels_p[p], labels_t[g]) - weight * max(others, default=0.0))
    return gained / len(true) if pred and true else 0.0


def test_name_reward_of_random_labels(spark, made):
    every, pred, true, _ = made
    rng = random.Random(2)
    said = {r: [rng.choice(WORDS) for _ in p] for r, _, p, _ in every}
    names = {r: [rng.choice(WORDS) for _ in t] for r, _, _, t in every}
    of = lambda table, key: spark.createDataFrame([(r, k, w) for r, ws in table.items() for k, w in enumerate(ws)], f"rec long, {key} long, label string")
    like = lambda a, b: F.when(a == b, 1.0).when(F.length(a) == F.length(b), 0.5).otherwise(0.0)
    got = {r.rec: r.name_reward for r in segmentation.name_reward(pred.join(of(said, "p"), ["rec", "p"]), true.join(of(names, "g"), ["rec", "g"]), ["rec"], like).collect()}
    alike = lambda a, b: 1.0 if a == b else 0.5 if len(a) == len(b) else 0.0
    assert got == pytest.approx({r: plain_name(p, t, said[r], names[r], alike, 0.5) for r, _, p, t in every if p or t})


def rendered(rng, segments, dash):
    """A completion that says ``segments``, with white space and capitals that the grammar allows."""
    space = lambda: rng.choice(["", " ", "\n"])
    tag = lambda t: t.upper() if rng.random() < 0.3 else t
    inner = "".join(f"<{tag('seg')}>{space()}<name>{space()}{n}{space()}</name>{space()}<span>{space()}{a} {dash} {b}{space()}</span>{space()}</seg>" for n, a, b in segments)
    return f"<think>{rng.choice(['', 'why', 'a < b'])}</think>{space()}<segments>{inner}</segments>"


def test_completions_are_read_as_written(spark):
    rng = random.Random(7)
    said, rows = {}, []
    for k in range(60):
        segments = [(rng.choice(WORDS), rng.randrange(400) / 10, rng.randrange(400) / 10) for _ in range(rng.randrange(5))]
        said[k] = segments
        rows.append((k, rendered(rng, segments, rng.choice(["to", "TO", "-", "–", "—"]))))
    rows += [(100, "<seg><name>n</name><span>1.2.3 to 4</span></seg>"), (101, "<seg><name>n</name><span>to 4</span></seg>"), (102, ""), (103, None)]
    frame = spark.createDataFrame(rows, "k long, text string")
    got = {r.k: [tuple(x) for x in r.v or []] for r in frame.select("k", tx.parsed_segments(F.col("text")).alias("v")).collect()}
    assert got == said | {k: [] for k in (100, 101, 102, 103)}


def test_format_reward_by_its_rule(spark):
    """1 for the whole form with segments in time and of positive length, 0.5 for the form only, else 0."""
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(80):
        times = sorted(rng.sample(range(200), 8))
        segments = [(rng.choice(WORDS), float(a), float(b)) for a, b in zip(times[::2], times[1::2])][: rng.randrange(5)]
        change = rng.choice(["none", "swap", "turn", "text before", "no think", "text after"])
        if change == "swap":
            segments = segments[::-1]
        if change == "turn":
            segments = [(n, b, a) for n, a, b in segments]
        text = "<think>t</think>\n<segments>" + "".join(f"<seg><name>{n}</name><span>{a} to {b}</span></seg>" for n, a, b in segments) + "</segments>"
        text = {"text before": "so: " + text, "no think": re.sub("<think>.*</think>\n", "", text), "text after": text + " end"}.get(change, text)
        rows.append((k, text))
        form = bool(segments) and change in ("none", "swap", "turn")
        in_time = all(b > a for _, a, b in segments) and all(x[1] <= y[1] for x, y in zip(segments, segments[1:]))
        want[k] = (1.0 if in_time else 0.5) if form else 0.0
    frame = spark.createDataFrame(rows, "k long, text string")
    assert {r.k: r.v for r in frame.select("k", tx.format_reward(F.col("text")).alias("v")).collect()} == want
