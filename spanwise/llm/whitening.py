"""Whitening of vectors: principal axes of the distinct vectors by Chan's merging of moments.

Entries become whole numbers, ``x = floor(SCALE * c) + OFFSET``. The axes are fitted
on the fit list, each distinct vector of whole numbers once. Every task goes through
its part of the list and keeps a count, exact sums, the mean and the scatter about
that mean; two such states are merged by Chan's formula, in pairs, in a tree
(``treeReduce``), so that the driver gets a few states of the vectors' width squared,
however many tasks there are. The eigenvectors are found there. A second pass over the list
sums the whitened values in the same way and tells how far their covariance is from
the identity.

All sums are taken about ``OFFSET``, without which squares of about 10^12 would hide
variances of about 10. Sums and squared distances are exact: where 64 bits might not
do, Python's integers are used.

Defined cases: rows whose vector is null or holds a null or non-finite entry are
left out; the width is that of most of the other rows (of two such, the smaller), and vectors of
other widths, empty ones too, belong to another space and are left out; entries are
held within ``±LIMIT`` after scaling; a squared distance beyond 64 bits is null; axes without
variance (up to rounding) have no row, so that vectors that are all alike, or only
one, give none; rows that repeat and rows without ``vec_id`` are each answered; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, scratch, sent

SCALE, OFFSET = 64.0, 1_000_000
#: Scaled entries beyond this are held at it: sums of so many bits stay exact.
LIMIT = float(1 << 48)
#: Axes that are used at most, and the variance below which an axis has none, as a share of the largest.
AXES, LEAST = 16, 1e-11
#: Vectors that a task works on at once.
ROWS = 4096


# ---- moments


@dataclass
class Moments:
    """Count, exact sums, mean and scatter (sums of products about the mean) of vectors."""

    n: int
    sums: np.ndarray  # of Python integers; empty for values that are not whole
    mean: np.ndarray
    scatter: np.ndarray


def moments_of(x: np.ndarray, whole: bool) -> Moments:
    """The moments of the rows of ``x``, centred before they are multiplied."""
    mean = x.mean(axis=0, dtype=np.float64)
    d = x - mean
    # rows of at most LIMIT: a sum of ROWS of them has 60 bits
    sums = x.sum(axis=0, dtype=np.int64).astype(object) if whole else np.empty(0, object)
    return Moments(len(x), sums, mean, d.T @ d)


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """Chan's formula for the moments of both; None stands for no vectors."""
    if a is None or b is None:
        return b if a is None else a
    n = a.n + b.n
    d = b.mean - a.mean
    return Moments(n, a.sums + b.sums, a.mean + d * (b.n / n), a.scatter + b.scatter + np.outer(d, d) * (a.n / n * b.n))


def reduced(parts: DataFrame) -> Moments | None:
    """One state of all in ``parts`` (a pickled state a row), merged in a tree; at most four of them reach the driver."""
    nothing = parts.sparkSession.sparkContext.parallelize([None], 1)  # a list may be empty
    states = nothing.union(parts.rdd.map(lambda r: pickle.loads(r[0])))
    return states.treeReduce(merged, depth=max(2, ceil(log2(states.getNumPartitions()))))


# ---- vectors of whole numbers, as bytes


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """``x - OFFSET`` of entries: ``floor(SCALE * c)``, held within the limit."""
    return np.floor(np.clip(SCALE * values.astype(np.float64), -LIMIT, LIMIT)).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes of the least of three widths that holds it: equal rows, and only they, have equal bytes."""
    most = np.maximum(x.max(axis=1), -x.min(axis=1) - 1)
    out: list[bytes] = [b""] * len(x)
    for kind, low, high in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 62)):
        at = np.flatnonzero((most >= low) & (most < high))
        for i, row in zip(at.tolist(), x[at].astype(kind)):
            out[i] = row.tobytes()
    return out


def unpacked(cells: list[bytes], width: int) -> np.ndarray:
    """The rows that :func:`packed` took."""
    out = np.empty((len(cells), width), np.int64)
    size = np.fromiter(map(len, cells), np.int64, len(cells)) // width
    for bytes_each in (2, 4, 8):
        at = np.flatnonzero(size == bytes_each)
        if len(at):
            out[at] = np.frombuffer(b"".join([cells[i] for i in at.tolist()]), f"<i{bytes_each}").reshape(len(at), width)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _usable(vector: Column) -> Column:
    """Whether a vector (of doubles) is there with finite entries only."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def vectors(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``vec_id, vector`` (doubles) of the rows that have one of the common width, and this width (0: none has)."""
    all_ = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(_usable(F.col("vector")) & (F.size("vector") > 0))
    width = all_.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = width["width"] if width else 0
    return all_.where(F.size("vector") == width), width


# ---- fit


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = whole_numbers(_matrix(batch.column(0).slice(at, ROWS), width))
                yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary())], names=["x"])

    return run


def fit_list(rows: DataFrame, width: int) -> DataFrame:
    """Each distinct vector of whole numbers once, as bytes ``x``. Copies fall together in the tasks that read them, before any shuffle."""
    return rows.select("vector").mapInArrow(_packed(width), "x binary").distinct()


def _moments(width: int, seen=None):
    """A task's moments, of the whole numbers or of what ``seen`` makes of them, as one pickled row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = unpacked(batch.column(0).slice(at, ROWS).to_pylist(), width)
                total = merged(total, moments_of(x, True) if seen is None else moments_of(seen.value.whitened(x), False))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["state"])

    return run


@dataclass
class Whitening:
    """A fitted transform. Sums are about ``OFFSET``; axes are rows, by falling variance, only those in use."""

    width: int
    n: int
    sums: list[int]
    axes: np.ndarray
    variance: np.ndarray
    total: float  # the trace of the covariance
    identity_error: float = 0.0

    def away(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact; Python integers where 64 bits might not do."""
        most = max(int(np.abs(x).max(initial=0)), 1) * self.n + max((abs(s) for s in self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, away: np.ndarray) -> list[int | None]:
        """The exact sum of the squares of each row; None beyond 64 bits."""
        most = int(abs(away).max(initial=0))
        if most * most * self.width < 1 << 62:
            return (away.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = (away.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]

    def projected(self, away: np.ndarray) -> np.ndarray:
        return (away / self.n).astype(np.float64) @ self.axes.T / np.sqrt(self.variance)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.projected(self.away(x))


def fit(listed: DataFrame, width: int, axes: int = AXES) -> Whitening | None:
    """The whitening of the vectors ``listed`` (see :func:`fit_list`); None without any. Reads them twice."""
    spark = listed.sparkSession
    state = reduced(listed.mapInArrow(_moments(width), "state binary"))
    if state is None:
        return None
    covariance = state.scatter / state.n
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-e, kind="stable")[:axes]
    order = order[e[order] > max(LEAST * e.max(), 0.0)]
    out = Whitening(width, state.n, [int(s) for s in state.sums], v[:, order].T.copy(), e[order], float(np.trace(covariance)))
    if len(order):
        with sent(spark, out) as held:
            again = reduced(listed.mapInArrow(_moments(width, held), "state binary"))
        out.identity_error = float(np.abs(again.scatter / again.n - np.eye(len(order))).max())
    return out


# ---- transform


def _transformed(width: int, model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.axes)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                away = model.away(whole_numbers(_matrix(part.column("vector"), width)))
                n = part.num_rows
                each = np.repeat(np.arange(n), k)
                deviation = pa.array(model.deviations(away), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, model.n, np.int64)),
                        deviation.take(pa.array(each)),
                        pa.array(model.projected(away).ravel()),
                        pa.array(np.tile(model.variance / model.total, n)),
                        pa.array(np.full(n * k, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", axes: int = AXES) -> DataFrame:
    """A row for each usable vector and axis: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Only the fit's result leaves Spark, of the vectors' width times ``axes``; rows are
    transformed where they are read, without a shuffle.
    """
    spark = rows.sparkSession
    with scratch(spark):
        usable, width = vectors(rows, key, vector)
        model = fit(cut(fit_list(usable, width), "whitening-list"), width, axes) if width else None
    if model is None or not len(model.axes):
        return spark.createDataFrame([], SCHEMA)
    return usable.mapInArrow(_transformed(width, model), SCHEMA)
