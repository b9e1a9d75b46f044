"""Linear models fitted by sums over tasks: logistic regression, principal axes, grouped and nested out-of-fold scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled
from .metrics import cumulative


@dataclass
class Model:
    """Imputation and scaling of the features, their principal axes if any, and a logistic model on them."""

    mean: np.ndarray
    spread: np.ndarray
    axes: np.ndarray | None
    weight: np.ndarray
    bias: float
    balance: tuple[float, float]  # weights of rows of class 0 and 1

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), self.mean, x) - self.mean) / self.spread
        return z if self.axes is None else z @ self.axes.T

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weight + self.bias, -30, 30)))


def axes_of(covariance: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading principal axes as rows; signs fixed by the largest component."""
    values, vectors = np.linalg.eigh(covariance)
    v = vectors[:, np.argsort(-values, kind="stable")[:k]].T
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]


def pca(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of a matrix that one task holds."""
    mean = x.mean(axis=0)
    return mean, axes_of((x - mean).T @ (x - mean), k)


def randomized_pca(rows: DataFrame, vector: str, k: int, oversampled: int = 8, rounds: int = 3, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal axes of all rows' vectors by a randomised range finder; tasks sum x (x . Q), a few columns wide."""
    head = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first()
    width = head["d"]

    def sums(of):
        def run(batches):
            total = 0.0
            for pdf in batches:
                total = total + of(np.stack(pdf[vector].to_numpy()).astype(float))
            if not np.isscalar(total):
                yield pd.DataFrame({"pos": np.arange(total.size), "value": total.ravel()})

        got = rows.where(F.col(vector).isNotNull()).select(vector).mapInPandas(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(len(got))
        out[[r["pos"] for r in got]] = [r["value"] for r in got]
        return out

    counted = sums(lambda x: np.append(x.sum(axis=0), len(x)))
    mean = counted[:-1] / counted[-1]
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(k + oversampled, width))))
    for _ in range(rounds):
        g = sums(lambda x, q=q: (x - mean).T @ ((x - mean) @ q)).reshape(width, -1)
        q, r = np.linalg.qr(g)
    b = q.T @ sums(lambda x: (x - mean).T @ ((x - mean) @ q)).reshape(width, -1)
    return mean, axes_of((b + b.T) / 2, k) @ q.T


#: Which rows a model is not fitted on: those of an outer fold, and of an inner one (-1: none).
Left = tuple[int, int]


def _summed(rows: DataFrame, features: list[str], y: str, left: list[Left], of) -> list[np.ndarray | None]:
    """For each model the sum over its rows of ``of(k, x, y)``, an array; one row a model, place and task is shuffled."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            x, t = pdf[features].to_numpy(float), pdf[y].to_numpy(float)
            outer, inner = pdf["__outer"].to_numpy(), pdf["__inner"].to_numpy()
            for k, (a, b) in enumerate(left):
                mine = (outer != a) & (inner != b)
                if mine.any():
                    total[k] = total.get(k, 0) + of(k, x[mine], t[mine])
        for k, v in total.items():
            yield pd.DataFrame({"k": k, "pos": np.arange(len(v)), "value": v})

    got = rows.mapInPandas(run, "k int, pos int, value double").groupBy("k", "pos").agg(F.sum("value").alias("value")).collect()
    out: list[np.ndarray | None] = [None] * len(left)
    for k in {r["k"] for r in got}:
        mine = sorted((r["pos"], r["value"]) for r in got if r["k"] == k)
        out[k] = np.array([v for _, v in mine])
    return out


def fit(rows: DataFrame, features: list[str], y: str, left: list[Left], least: int = 10, components: int | None = None, l2: float = 1.0, rounds: int = 30) -> list[Model | None]:
    """A model for each of ``left`` by Newton's method on sums over tasks; None for too few rows or one class.

    Missing values take the mean of the model's own rows. Classes weigh the same; the
    penalty is ``l2 / n`` half squares of the weights, the bias is free. ``rows`` has
    ``__outer`` and ``__inner``.
    """
    d = len(features)
    first = _summed(rows, features, y, left, lambda k, x, t: np.concatenate([[len(t), t.sum()], (~np.isnan(x)).sum(axis=0), np.nansum(x, axis=0)]))
    usable = [s is not None and s[0] >= least and 0 < s[1] < s[0] for s in first]
    means = [s[2 + d :] / np.maximum(s[2 : 2 + d], 1) if s is not None else np.zeros(d) for s in first]

    def gram(k, x, t):
        z = np.where(np.isnan(x), means[k], x) - means[k]
        return (z.T @ z).ravel()

    models: list[Model | None] = []
    for s, ok, mean, g in zip(first, usable, means, _summed(rows, features, y, left, gram)):
        if not ok:
            models.append(None)
            continue
        n, pos = s[0], s[1]
        covariance = g.reshape(d, d) / n
        spread = np.sqrt(np.diag(covariance)) + 1e-8
        axes = axes_of(covariance / np.outer(spread, spread), components) if components else None
        models.append(Model(mean, spread, axes, np.zeros(components or d), 0.0, (n / (2 * (n - pos)), n / (2 * pos))))

    def slope(k, x, t):
        m = models[k]
        if m is None:
            return np.zeros(1)
        z = np.column_stack([m.inputs(x), np.ones(len(t))])
        p = 1 / (1 + np.exp(-np.clip(z @ np.append(m.weight, m.bias), -30, 30)))
        weight = np.where(t == 1, m.balance[1], m.balance[0])
        return np.concatenate([z.T @ (weight * (p - t)), (z.T @ (z * (weight * p * (1 - p))[:, None])).ravel()])

    for _ in range(rounds):
        moved = 0.0
        for m, s, at in zip(models, first, _summed(rows, features, y, left, slope)):
            if m is None:
                continue
            n, k = s[0], len(m.weight) + 1
            penalty = np.append(np.full(k - 1, l2 / n), 0.0)
            step = np.linalg.solve(at[k:].reshape(k, k) / n + np.diag(penalty) + 1e-12 * np.eye(k), at[:k] / n + penalty * np.append(m.weight, m.bias))
            m.weight, m.bias = m.weight - step[:-1], m.bias - step[-1]
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    return models


def _scored(rows: DataFrame, row: str, features: list[str], models: dict[Left, Model | None], named) -> DataFrame:
    """``row, fold, score`` of each row under the models that ``named(outer, inner)`` gives: columns of fold numbers and keys."""

    def run(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(float)
            outer, inner = pdf["__outer"].to_numpy(), pdf["__inner"].to_numpy()
            for key, fold, mine in named(outer, inner):
                at = np.flatnonzero(mine)
                if len(at):
                    m = models.get(key)
                    score = m.scores(x[at]) if m else np.full(len(at), np.nan)
                    yield pd.DataFrame({row: pdf[row].to_numpy()[at], "fold": fold, "score": score})

    out = rows.mapInPandas(run, f"{row} long, fold int, score double")
    return out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def out_of_fold(rows: DataFrame, fold: str, row: str, features: list[str], y: str, folds: int, least: int = 10, components: int | None = None) -> DataFrame:
    """``row, fold, score``: each fold scored by a model fitted on the others; null where they have too few rows or one class.

    Imputation, scaling and principal axes are those of the fitted rows. With a fold
    a recording this is leave-one-recording-out.
    """
    rows = settled(rows.select(row, F.col(fold).cast("int").alias("__outer"), F.lit(-2).alias("__inner"), F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in features]))
    left = [(f, -1) for f in range(folds)]
    models = dict(zip(left, fit(rows, features, y, left, least, components)))
    return _scored(rows, row, features, models, lambda outer, inner: [((f, -1), f, outer == f) for f in range(folds)])


def nested(rows: DataFrame, fold: str, inner: str, row: str, features: list[str], y: str, folds: int, inner_folds: int, target: float, least: int = 10, components: int | None = None) -> DataFrame:
    """Nested cross-validation: per outer fold ``fold, n, threshold, kept, right``.

    A fold's threshold comes from the scores that inner folds of the other outer
    folds get from models without them: the loosest whose prefix of ``least`` rows or
    more keeps ``target`` precision with one more error. The fold itself is scored by
    a model of all the others. A fold without a threshold keeps nothing, and is listed.
    """
    rows = settled(rows.select(row, F.col(fold).cast("int").alias("__outer"), F.col(inner).cast("int").alias("__inner"), F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in features]))
    left = [(f, g) for f in range(folds) for g in range(-1, inner_folds)]
    models = dict(zip(left, fit(rows, features, y, left, least, components)))
    inside = _scored(rows, row, features, models, lambda o, i: [((f, g), f, (o != f) & (i == g)) for f in range(folds) for g in range(inner_folds)])
    truth = rows.select(row, y)
    curve = cumulative(inside.join(truth, row), ["fold"], "score", y).where((F.col("n") >= least) & (F.col("tp") / (F.col("n") + 1) >= target))
    threshold = curve.groupBy("fold").agg(F.min("score").alias("threshold"))
    held = _scored(rows, row, features, models, lambda o, i: [((f, -1), f, o == f) for f in range(folds)]).join(truth, row).join(threshold, "fold", "left")
    keep = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    return held.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.first("threshold").alias("threshold"), F.count_if(keep).alias("kept"), F.count_if(keep & (F.col(y) == 1)).alias("right"))


def effective_rank(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """exp of the entropy of the normalised singular values of each group's vectors.

    Only the Gram matrix of a group is formed, of the vectors' width squared; it is
    summed over Arrow batches, so a group's size does not matter.
    """

    def gram(batches):
        for pdf in batches:
            for k, part in pdf.groupby(key, sort=True):
                x = np.stack(part[vector].to_numpy()).astype(float)
                yield pd.DataFrame({key: [k], "n": [len(x)], "s": [x.sum(axis=0).tolist()], "g": [(x.T @ x).ravel().tolist()]})

    def rank(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].sum()
        s, g = np.sum(np.stack(pdf["s"]), axis=0), np.sum(np.stack(pdf["g"]), axis=0)
        centred = g.reshape(len(s), len(s)) - np.outer(s, s) / n
        sigma = np.sqrt(np.clip(np.linalg.eigvalsh(centred), 0, None))
        p = sigma[sigma > 0] / sigma.sum()
        return pd.DataFrame({key: [k[0]], "n": [int(n)], "effective_rank": [float(np.exp(-(p * np.log(p)).sum()))]})

    kind = dict(rows.dtypes)[key]
    parts = rows.select(key, vector).mapInPandas(gram, f"{key} {kind}, n long, s array<double>, g array<double>")
    return parts.groupBy(key).applyInPandas(rank, f"{key} {kind}, n long, effective_rank double")


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided binomial test of k of n against one half: both tails as far out as k."""
    from math import exp, lgamma, log

    low = min(k, n - k)
    if 2 * low >= n - 1 + n % 2:
        return 1.0
    # terms fall towards the tail: those under 1e-18 of the first do not show
    term = exp(lgamma(n + 1) - lgamma(low + 1) - lgamma(n - low + 1) - n * log(2))
    total, i = 0.0, low
    while i >= 0 and term > 1e-18 * max(total, 1e-300):
        total += term
        term *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * total)
