"""Column expressions on numbers, intervals and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def iou_hull(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the hull of both intervals; 0 where the hull is empty."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, overlap(a0, a1, b0, b1) / hull).otherwise(0.0)


def iou_sum(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the sum of lengths less the overlap; differs from the hull form for inverted spans only."""
    inter = overlap(a0, a1, b0, b1)
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def alignment(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """IoU damped by how far start and end are off, in units of b's length; never negative."""
    length = b1 - b0
    raw = iou_hull(a0, a1, b0, b1) * (1 - F.abs(a0 - b0) / length) * (1 - F.abs(a1 - b1) / length)
    return F.when(length > 0, F.greatest(raw, F.lit(0.0))).otherwise(0.0)


def interval_distance(t: Column, lo: Column, hi: Column) -> Column:
    """0 inside, else the distance to the nearer edge."""
    return F.greatest(lo - t, t - hi, F.lit(0.0))


def signed_distance(t: Column, lo: Column, hi: Column) -> Column:
    """As :func:`interval_distance`, negative before the interval."""
    return F.when(t < lo, t - lo).when(t > hi, t - hi).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    """The logistic function, its argument clipped to 30 either way."""
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k of n; null for n = 0."""
    p, z2 = k / n, z * z
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    some = n > 0
    return F.when(some, mid - half), F.when(some, mid + half)


def safe_ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def f1(precision: Column, recall: Column) -> Column:
    return safe_ratio(2 * precision * recall, precision + recall)


def bucket(x: Column, edges: list[float], names: list[str]) -> Column:
    """The name of the half-open range that x falls in: below the first edge, ..., from the last on."""
    out = F.when(x < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:]):
        out = out.when(x < edge, name)
    return out.when(x.isNotNull(), names[-1])


def tri_state(x: Column) -> Column:
    """An observation, where all that is not plainly present or absent is not observable."""
    return F.when(x.isin("OBSERVED_PRESENT", "OBSERVED_ABSENT"), x).otherwise("NOT_OBSERVABLE")


def encode_answer(x: Column) -> Column:
    """yes 1, no 0, unclear one half, else null."""
    return F.when(x == "yes", 1.0).when(x == "no", 0.0).when(x == "unclear", 0.5)


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("yes", "true", "1"), F.lit(False))


def box_area(b: dict[str, Column]) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def box(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")}


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    inter = overlap(a["x0"], a["x1"], b["x0"], b["x1"]) * overlap(a["y0"], a["y1"], b["y0"], b["y1"])
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def box_diagonal(b: dict[str, Column]) -> Column:
    return F.sqrt((b["x1"] - b["x0"]) ** 2 + (b["y1"] - b["y0"]) ** 2)


def box_expand(b: dict[str, Column], by: float) -> dict[str, Column]:
    """Every side moved out by a share of the box's width or height."""
    w, h = (b["x1"] - b["x0"]) * by, (b["y1"] - b["y0"]) * by
    return {"x0": b["x0"] - w, "y0": b["y0"] - h, "x1": b["x1"] + w, "y1": b["y1"] + h}


def box_union(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {"x0": F.least(a["x0"], b["x0"]), "y0": F.least(a["y0"], b["y0"]), "x1": F.greatest(a["x1"], b["x1"]), "y1": F.greatest(a["y1"], b["y1"])}


def edge_touch(b: dict[str, Column], width: float, height: float, margin: float = 0.01) -> Column:
    """Whether the box comes within a margin of the frame's edge."""
    return (b["x0"] <= width * margin) | (b["y0"] <= height * margin) | (b["x1"] >= width * (1 - margin)) | (b["y1"] >= height * (1 - margin))


def point_box_gap(x: Column, y: Column, b: dict[str, Column]) -> Column:
    return F.sqrt(interval_distance(x, b["x0"], b["x1"]) ** 2 + interval_distance(y, b["y0"], b["y1"]) ** 2)


def smart_resize(height: Column, width: Column, factor: int, most_pixels: int) -> tuple[Column, Column]:
    """Sides rounded to multiples of a factor, scaled down to a budget of pixels."""
    h, w = F.bround(height / factor) * factor, F.bround(width / factor) * factor
    scale = F.sqrt(height * width / F.lit(float(most_pixels)))
    small = lambda s: F.greatest(F.floor(s / scale / factor) * factor, F.lit(factor))
    over = h * w > most_pixels
    return F.when(over, small(height)).otherwise(h).cast("long"), F.when(over, small(width)).otherwise(w).cast("long")
