"""Tracks: association of boxes frame by frame, and features of trajectories; one recording is one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import box_iou


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


CORNERS = ("x0", "y0", "x1", "y1")
Live = dict[int, tuple[tuple[float, float, float, float], str, float]]


def associate(live: Live, fresh: int, when: float, boxes: list[tuple], most_gap: float, least: float, bonus: float) -> tuple[Live, int, list[int]]:
    """Tracks still live after a frame, the next number, and the track of each of its ``boxes`` (id, label, corners).

    A track unseen for over ``most_gap`` has ended. Pairs over ``least`` IoU are taken
    by falling IoU plus ``bonus`` for an equal label; a box without one starts a track.
    """
    live = {k: v for k, v in live.items() if when - v[2] <= most_gap}
    pairs = []
    for k, (corners, label, _) in live.items():
        for i, (_, own, mine) in enumerate(boxes):
            overlap = _iou(corners, mine)
            if overlap > least:
                pairs.append((-(overlap + bonus * (label == own)), k, i))
    used, taken = set(), {}
    for _, k, i in sorted(pairs):
        if k not in used and i not in taken:
            used.add(k)
            taken[i] = k
    for i, (_, label, corners) in enumerate(boxes):
        if i not in taken:
            taken[i], fresh = fresh, fresh + 1
        live[taken[i]] = (corners, label, when)
    return live, fresh, [taken[i] for i in range(len(boxes))]


def frames_of(pdf: pd.DataFrame, t: str):
    """Time and boxes (id, label, corners) of each frame in order."""
    for when, frame in pdf.sort_values([t, "box_id"]).groupby(t):
        yield when, [(r.box_id, r.label, (r.x0, r.y0, r.x1, r.y1)) for r in frame.itertuples()]


def track(rows: DataFrame, key: str, t: str, most_gap: float, least: float = 0.1, bonus: float = 0.2) -> DataFrame:
    """Boxes (key, t, box_id, label, x0..y1) with ``track``: best IoU plus a bonus for an equal label, greedily, frame by frame.

    A track that was not seen for ``most_gap`` ends; a box without a match starts one.
    A recording is cut where no frame follows for so long: no track goes across. The
    pieces are dealt to tasks, which read them in the stream of their rows and hold the
    live tracks only. Numbers count the tracks of a recording in order of time.
    """
    kinds = dict(rows.dtypes)
    told = F.col(key).isNotNull() & F.col(t).isNotNull()
    held = rows.where(told & ~F.isnan(t) if kinds[t] in ("double", "float") else told).select(key, t, "box_id", "label", *CORNERS)
    w = W.partitionBy(key).orderBy(t)
    apart = F.coalesce((F.col(t) - F.lag(t).over(w) > most_gap).cast("int"), F.lit(1))
    cut = held.withColumn("__apart", apart).withColumn("__piece", F.sum("__apart").over(w)).drop("__apart")
    dealt = cut.repartition(key, "__piece").sortWithinPartitions(key, "__piece", t, F.col("box_id").asc_nulls_last(), "label", *CORNERS)

    def run(batches):
        # rows come frame by frame; one is done when the next begins
        at, when, boxes, live, fresh, out = None, None, [], {}, 0, []

        def done():
            after, following, numbers = associate(live, fresh, when, boxes, most_gap, least, bonus)
            out.extend((*at, when, b[0], k, int(k >= fresh)) for b, k in zip(boxes, numbers))
            return after, following

        for pdf in batches:
            for k, piece, now, i, label, *corners in zip(*(pdf[c].tolist() for c in (key, "__piece", t, "box_id", "label", *CORNERS))):
                if boxes and (at != (k, piece) or when != now):
                    live, fresh = done()
                    boxes = []
                if at != (k, piece):
                    at, live, fresh = (k, piece), {}, 0
                when = now
                boxes.append((i, label, tuple(corners)))
            yield pd.DataFrame(out, columns=[key, "__piece", t, "box_id", "track", "__new"])
            out.clear()
        if boxes:
            done()
            yield pd.DataFrame(out, columns=[key, "__piece", t, "box_id", "track", "__new"])

    each = dealt.mapInPandas(run, f"{key} {kinds[key]}, __piece long, {t} {kinds[t]}, box_id {kinds['box_id']}, track int, __new int")
    before = F.coalesce(F.sum("__new").over(W.partitionBy(key).orderBy("__piece").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    return each.select(key, t, F.col("box_id").cast("long").alias("box_id"), (F.col("track") + before).cast("int").alias("track"))


def savgol(x: np.ndarray, window: int = 5, degree: int = 2) -> np.ndarray:
    """Savitzky-Golay smoothing of one run; the ends by the polynomial of the first and last window."""
    if len(x) < window:
        return x.copy()
    half, i = window // 2, np.arange(window) - window // 2
    fit = np.linalg.pinv(np.vander(i, degree + 1, increasing=True))
    out = np.convolve(x, fit[0][::-1], "same")
    for part, at in ((x[:window], i[:half]), (x[-window:], i[-half:])):
        value = np.vander(at, degree + 1, increasing=True) @ (fit @ part)
        if at[0] < 0:
            out[:half] = value
        else:
            out[-half:] = value
    return out


def smoothed_runs(rows: DataFrame, key: str, t: str, x: str, most_gap: float) -> DataFrame:
    """Smoothing inside runs of known values with no gap over ``most_gap``; nothing across gaps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t).reset_index(drop=True)
        known = pdf[pdf[x].notna()]
        part = (known[t].diff() > most_gap).cumsum()
        pdf["smooth"] = np.nan
        for _, r in known.groupby(part):
            pdf.loc[r.index, "smooth"] = savgol(r[x].to_numpy(float))
        return pdf[[key, t, "smooth"]]

    kinds = dict(rows.dtypes)
    return rows.select(key, t, x).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {t} double, smooth double")


def trajectory_features(rows: DataFrame, key: str, t: str, x: str, y: str, floor: float = 1e-3, shuffles: int = 20) -> DataFrame:
    """Per trajectory: reversals along the main axis, stops, straightness, periodicity against shuffles, share of the spectrum."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        p = pdf[[x, y]].to_numpy(float)
        v = np.diff(p, axis=0)
        speed = np.linalg.norm(v, axis=1)
        out = {key: pdf[key].iloc[0], "n": len(p), "reversals": 0, "stops": 0, "straightness": None, "periodicity": None, "band": None}
        if len(p) >= 8 and speed.sum() > 0:
            _, axes = np.linalg.eigh(np.cov(p.T))
            along = v @ axes[:, -1]
            sign = np.sign(along[np.abs(along) > floor])
            out["reversals"] = int((sign[1:] != sign[:-1]).sum())
            slow = speed < 0.1 * speed.max()
            out["stops"] = int((np.diff(slow.astype(int), prepend=0) == 1).sum())
            out["straightness"] = float(np.linalg.norm(p[-1] - p[0]) / speed.sum())

            def peak(s):
                s = s - s.mean()
                r = np.correlate(s, s, "full")[len(s) - 1 :]
                return float(r[2 : len(s) // 2].max() / r[0]) if r[0] > 0 and len(s) >= 6 else 0.0

            rng = np.random.default_rng(int(len(p)))
            out["periodicity"] = peak(along) - float(np.mean([peak(rng.permutation(along)) for _ in range(shuffles)]))
            power = np.abs(np.fft.rfft(along - along.mean())) ** 2
            out["band"] = float(power[1:].max() / power.sum()) if power.sum() > 0 else None
        return pd.DataFrame([out])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, t, x, y).groupBy(key).applyInPandas(run, f"{key} {kind}, n long, reversals long, stops long, straightness double, periodicity double, band double")


def two_per_frame(rows: DataFrame, key: str, t: str) -> DataFrame:
    """The first two boxes of each frame by id, with their place ``k`` and the frame's number ``f`` in the recording."""
    first = rows.withColumn("k", F.row_number().over(W.partitionBy(key, t).orderBy("box_id")))
    return first.withColumn("f", F.dense_rank().over(W.partitionBy(key).orderBy(t))).where("k <= 2")


def link_cost(p: dict[str, Column], q: dict[str, Column], label_penalty: float = 0.5) -> Column:
    """Distance of two boxes' centres in mean diagonals, less their IoU, plus a penalty for unlike labels."""

    def diagonal(b):
        return F.sqrt((b["x1"] - b["x0"]) ** 2 + (b["y1"] - b["y0"]) ** 2)

    scale = (diagonal(p) + diagonal(q)) / 2
    apart = F.sqrt(((p["x0"] + p["x1"] - q["x0"] - q["x1"]) / 2) ** 2 + ((p["y0"] + p["y1"] - q["y0"] - q["y1"]) / 2) ** 2)
    return apart / F.when(scale > 1e-6, scale).otherwise(1.0) - box_iou(p, q) + F.when(p["label"] != q["label"], label_penalty).otherwise(0.0)


def least_cost_links(rows: DataFrame, key: str, t: str, most_cost: float) -> DataFrame:
    """``key, a, z, cost``: boxes of a frame linked with those of the next at the least total cost, at most two a frame.

    Two by two there are two ways, straight and crossed; else the cheapest single
    link is taken. A link over ``most_cost`` is dropped: its box starts a track.
    """
    two = two_per_frame(rows, key, t)
    names = ("box_id", "label", "x0", "y0", "x1", "y1")
    p = two.select(key, "f", F.col("k").alias("pk"), *[F.col(n).alias(f"p_{n}") for n in names])
    q = two.select(key, (F.col("f") - 1).alias("f"), F.col("k").alias("qk"), *[F.col(n).alias(f"q_{n}") for n in names])
    side = lambda s: {n: F.col(f"{s}_{n}") for n in names}
    c = p.join(q, [key, "f"]).withColumn("cost", link_cost(side("p"), side("q")))
    w = W.partitionBy(key, "f")
    same = F.col("pk") == F.col("qk")
    c = c.withColumns({"np": F.max("pk").over(w), "nq": F.max("qk").over(w), "straight": F.round(F.sum(F.when(same, F.col("cost"))).over(w), 9), "crossed": F.round(F.sum(F.when(~same, F.col("cost"))).over(w), 9), "best": F.row_number().over(w.orderBy(F.round("cost", 9), "pk", "qk"))})
    chosen = F.when((F.col("np") == 2) & (F.col("nq") == 2), same == (F.col("straight") <= F.col("crossed"))).otherwise(F.col("best") == 1)
    return c.where(chosen & (F.col("cost") <= most_cost)).select(key, F.col("p_box_id").alias("a"), F.col("q_box_id").alias("z"), "cost")


def two_track_features(rows: DataFrame, key: str, t: str, at: float) -> DataFrame:
    """Per recording of two tracks: ``presence_changes, distance_change`` (medians from ``at`` on and before), ``synchrony``.

    Distances are in the boxes' mean diagonals. Synchrony, one less the spread of the
    steps over their mean size, wants six frames with both; a missing distance is the mean.
    """
    two = two_per_frame(rows, key, t)
    centre = {"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "size": F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)}
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    d = F.sqrt((of(1, "cx") - of(2, "cx")) ** 2 + (of(1, "cy") - of(2, "cy")) ** 2) / F.greatest(F.avg("size"), F.lit(1e-6))
    frames = two.withColumns(centre).groupBy(key, t).agg(d.alias("d"))
    every, order = W.partitionBy(key), W.partitionBy(key).orderBy(t)
    filled = frames.withColumns({"n": F.count("d").over(every), "x": F.coalesce("d", F.avg("d").over(every))})
    steps = filled.withColumns({"dd": F.col("x") - F.lag("x").over(order), "flip": F.col("d").isNull() != F.lag(F.col("d").isNull()).over(order)})
    late = F.col(t) >= at
    mean = F.avg(F.abs("dd"))
    return steps.groupBy(key).agg(
        F.count_if("flip").alias("presence_changes"),
        F.abs(F.percentile(F.when(late, F.col("d")), 0.5) - F.percentile(F.when(~late, F.col("d")), 0.5)).alias("distance_change"),
        F.when((F.max("n") >= 6) & (mean > 0), 1 - F.stddev_pop("dd") / (mean + 1e-9)).alias("synchrony"),
    )
