"""What corrected labels change in a model's out-of-fold AUROC, against as many labels flipped at random.

Every label set (the labels as they were, as corrected, and a replicate with random
flips each) has a model a fold. They are fitted together: one pass over the rows sums
slopes and curvatures for all label sets, so that replicates cost no passes of their
own. A row's label in a replicate follows from a hash of its number and a limit a
replicate, which is found among sums of parts of the hash's range, so that exactly as
many labels are flipped as were corrected. Folds, means and spreads do not depend on
labels; folds are the same for all label sets.

Scores of a replicate are made in the stream of a task and summed by distinct score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics
from .lineage import settled
from .resample import PARTS, PRIME, shuffled

#: Label sets beside the replicates, which count from 0.
ORIGINAL, CORRECTED = -2, -1


@dataclass
class Labels:
    """Which rows each replicate flips: those up to ``limit`` in the order of hash and row number."""

    hashes: np.ndarray  # of the last row that is flipped, by replicate; -1: none is
    rows: np.ndarray

    def of(self, row: np.ndarray, original: np.ndarray, corrected: np.ndarray) -> np.ndarray:
        """Labels of rows by label set: original, corrected, replicates."""
        b = np.arange(len(self.hashes), dtype=np.int64)
        r, q = np.mod(row, PRIME)[:, None], np.mod(row, 10_007)[:, None]
        h = (r * ((b * 7919 + 104_729) % PRIME) + q * q * (b + 17)) % PRIME
        flip = (h < self.hashes) | (h == self.hashes) & (row[:, None] <= self.rows)
        y = original[:, None]
        return np.concatenate([y, corrected[:, None], np.where(flip, 1 - y, y)], axis=1).astype(float)


def limits(rows: DataFrame, row: str, n: int, replicates: int) -> Labels:
    """The last of the first ``n`` rows in each replicate's order. A replicate's parts, and then its limit, are what passes the driver."""
    hashes, last = np.full(replicates, -1, np.int64), np.full(replicates, -1, np.int64)
    if n <= 0 or replicates <= 0:
        return Labels(hashes, last)
    each = rows.select(row, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("b")).withColumn("h", shuffled("b", row)).withColumn("part", F.floor(F.col("h") * PARTS / PRIME))
    sums = each.groupBy("b", "part").agg(F.count(F.lit(1)).alias("c"))
    upto = sums.withColumn("upto", F.sum("c").over(W.partitionBy("b").orderBy("part")))
    edge = settled(upto.where((F.col("upto") >= n) & (F.col("upto") - F.col("c") < n)).select("b", "part", (n - F.col("upto") + F.col("c")).alias("left")))
    inside = each.join(F.broadcast(edge), ["b", "part"]).withColumn("k", F.row_number().over(W.partitionBy("b").orderBy("h", row)))
    for r in inside.where("k = left").select("b", "h", row).collect():
        hashes[r["b"]], last[r["b"]] = r["h"], r[row]
    return Labels(hashes, last)


@dataclass
class Fold:
    """Scaling of the features by the rows outside a fold, and a weight vector (the bias last) for each label set; unusable sets score null."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray  # label sets x features + 1
    usable: np.ndarray
    balance: np.ndarray  # label sets x 2: weights of rows of class 0 and 1

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), self.mean, x) - self.mean) / self.spread
        return np.column_stack([z, np.ones(len(z))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weight.T, -30, 30)))


#: Rows that a task works on at once.
ROWS = 2048


def _summed(rows: DataFrame, features: list[str], folds: int, of) -> dict[int, np.ndarray]:
    """For each fold the sum over the rows outside it of ``of(fold, x, labels)``, an array; a row a fold, place and task is shuffled."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at : at + ROWS]
                x, fold = part[features].to_numpy(float), part["__fold"].to_numpy()
                told = part["__row"].to_numpy(np.int64), part["__y"].to_numpy(float), part["__c"].to_numpy(float)
                for f in range(folds):
                    mine = fold != f
                    if mine.any():
                        total[f] = total.get(f, 0) + of(f, x[mine], tuple(t[mine] for t in told))
        for f, v in total.items():
            yield pd.DataFrame({"f": f, "pos": np.arange(v.size), "value": v.ravel()})

    got = rows.mapInPandas(run, "f int, pos int, value double").groupBy("f", "pos").agg(F.sum("value").alias("value")).toPandas()
    return {int(f): g.sort_values("pos")["value"].to_numpy() for f, g in got.groupby("f")}


def fit(rows: DataFrame, features: list[str], labels: Labels, folds: int, least: int = 10, l2: float = 1.0, rounds: int = 30) -> dict[int, Fold]:
    """Logistic models of all label sets on the rows outside each fold, by Newton's method; classes weigh the same.

    The penalty is ``l2 / n`` half squares of the weights, the bias is free. A label
    set is unusable in a fold where it has one class or fewer than ``least`` rows.
    """
    d, sets = len(features), len(labels.hashes) + 2
    first = _summed(rows, features, folds, lambda f, x, t: np.concatenate([[len(x)], (~np.isnan(x)).sum(axis=0), np.nansum(x, axis=0), labels.of(*t).sum(axis=0)]))
    means = {f: s[1 + d : 1 + 2 * d] / np.maximum(s[1 : 1 + d], 1) for f, s in first.items()}
    squares = _summed(rows, features, folds, lambda f, x, t: ((np.where(np.isnan(x), means[f], x) - means[f]) ** 2).sum(axis=0))
    models: dict[int, Fold] = {}
    for f, s in first.items():
        n, pos = s[0], s[1 + 2 * d :]
        usable = (n >= least) & (pos > 0) & (pos < n)
        balance = np.where(usable[:, None], n / (2 * np.maximum(np.stack([n - pos, pos], axis=1), 1)), 0.0)
        models[f] = Fold(means[f], np.sqrt(squares[f] / n) + 1e-8, np.zeros((sets, d + 1)), usable, balance)
    upper = np.triu_indices(d + 1)

    def slopes(f, x, t):
        m = models[f]
        z, y = m.inputs(x), labels.of(*t)
        p = m.scores(x)
        w = np.where(y == 1, m.balance[:, 1], m.balance[:, 0])
        return np.concatenate([(w * (p - y)).T @ z, (w * p * (1 - p)).T @ (z[:, upper[0]] * z[:, upper[1]])], axis=1)

    for _ in range(rounds):
        moved = 0.0
        for f, sums in _summed(rows, features, folds, slopes).items():
            m, n = models[f], first[f][0]
            sums = sums.reshape(sets, -1) / n
            penalty = np.append(np.full(d, l2 / n), 0.0)
            curve = np.zeros((sets, d + 1, d + 1))
            curve[:, upper[0], upper[1]] = curve[:, upper[1], upper[0]] = sums[:, d + 1 :]
            step = np.linalg.solve(curve + np.diag(penalty) + 1e-12 * np.eye(d + 1), (sums[:, : d + 1] + penalty * m.weight)[:, :, None])[:, :, 0]
            step[~m.usable] = 0.0
            m.weight = m.weight - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    return models


def impact(rows: DataFrame, row: str, fold: str, features: list[str], original: str, corrected: str, folds: int, replicates: int, least: int = 10) -> DataFrame:
    """``b, n, positives, auroc, unchanged`` of each label set: original (-2), corrected (-1) and replicates.

    Out-of-fold AUROC of a label set's models against its own labels, and against the
    original labels on the rows whose label was not corrected. ``rows`` are those that
    have both labels (0 or 1) and a whole number ``row`` each; others are left out.
    """
    held = rows.select(F.col(row).cast("long").alias("__row"), F.col(fold).cast("int").alias("__fold"), F.col(original).cast("int").alias("__y"), F.col(corrected).cast("int").alias("__c"), *[F.col(c).cast("double").alias(c) for c in features])
    held = settled(held.where("__y IN (0, 1) AND __c IN (0, 1) AND __row IS NOT NULL AND __fold IS NOT NULL"))
    changed = held.agg(F.count_if(F.col("__y") != F.col("__c"))).first()[0]
    labels = limits(held, "__row", changed, replicates)
    models = fit(held, features, labels, folds, least)

    def told(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                x, of = part[features].to_numpy(float), part["__fold"].to_numpy()
                y, c = part["__y"].to_numpy(), part["__c"].to_numpy()
                own = labels.of(part["__row"].to_numpy(np.int64), y.astype(float), c.astype(float))
                score = np.full(own.shape, np.nan)
                for f, m in models.items():
                    mine = of == f
                    if mine.any():
                        score[mine] = np.where(m.usable, m.scores(x[mine]), np.nan)
                n, sets = own.shape
                yield pd.DataFrame({"b": np.tile(np.arange(-2, sets - 2), n), "score": np.round(score, 12).ravel(), "own": own.ravel().astype(int), "y": np.repeat(y, sets), "same": np.repeat((y == c).astype(int), sets)})

    scored = held.mapInPandas(told, "b int, score double, own int, y int, same int").where("NOT isnan(score)")
    counts = settled(scored.groupBy("b", "score", "own", "y", "same").agg(F.count(F.lit(1)).alias("n")))
    whole = metrics.weighted_auroc(counts, ["b"], "score", "own", "n")
    kept = metrics.weighted_auroc(counts.where("same = 1"), ["b"], "score", "y", "n")
    return whole.select("b", (F.col("n_pos") + F.col("n_neg")).alias("n"), F.col("n_pos").alias("positives"), "auroc").join(kept.select("b", F.col("auroc").alias("unchanged")), "b", "left")


def verdict(impacts: DataFrame) -> DataFrame:
    """One row: the AUROC under both label sets, what corrections change over all and on unchanged rows, and where this stands among random flips (``p``: the share that change it at least as much)."""
    at = lambda b, c: F.max(F.when(F.col("b") == b, F.col(c)))
    base = impacts.agg(at(ORIGINAL, "n").alias("n"), at(ORIGINAL, "auroc").alias("original"), at(CORRECTED, "auroc").alias("corrected"), at(ORIGINAL, "unchanged").alias("unchanged_original"), at(CORRECTED, "unchanged").alias("unchanged_corrected"))
    base = base.withColumns({"delta": F.col("corrected") - F.col("original"), "unchanged_delta": F.col("unchanged_corrected") - F.col("unchanged_original")})
    null = impacts.where("b >= 0 AND auroc IS NOT NULL").join(F.broadcast(base)).withColumn("moved", F.col("auroc") - F.col("original"))
    nulls = null.agg(F.count(F.lit(1)).alias("draws"), F.avg("moved").alias("null_mean"), F.percentile("moved", 0.05).alias("null_p05"), F.percentile("moved", 0.95).alias("null_p95"), F.avg((F.col("moved") >= F.col("delta")).cast("double")).alias("p"))
    return base.join(F.broadcast(nulls))


def full_population(rows: DataFrame, row: str, fold: str, features: list[str], y: str, folds: int, least: int = 10) -> DataFrame:
    """``n, positives, auroc`` of one label set on all rows that have it. Two of these are of different rows: their difference is no gain."""
    return impact(rows, row, fold, features, y, y, folds, 0, least).where(F.col("b") == ORIGINAL).select("n", "positives", "auroc")
