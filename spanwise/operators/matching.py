"""One-to-one matching per group as folds over ordered candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_by(keys: list[str], *order: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def islands(rows: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """``rows`` with ``__island``: those of a group whose spans ``lo`` to ``hi`` hang together have one number."""
    w = W.partitionBy(*keys).orderBy("__lo", "__hi")
    held = rows.withColumns({"__lo": lo, "__hi": hi})
    reach = F.max("__hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = held.withColumn("__fresh", F.coalesce((F.col("__lo") > reach).cast("long"), F.lit(0)))
    return fresh.withColumn("__island", F.sum("__fresh").over(w)).drop("__lo", "__hi", "__fresh")


def greedy_pairs(candidates: DataFrame, keys: list[str], score: str, i: str, j: str, span: tuple[Column, Column] | None = None) -> DataFrame:
    """Pairs taken by falling score, then falling i and j, each side used once.

    ``span``: from when to when a candidate's two sides reach. Candidates whose spans
    do not hang together share no side, so each island is folded on a row of its own;
    without it a group is.
    """
    if span is not None:
        cut = islands(candidates, keys, *span)
        return greedy_pairs(cut, [*keys, "__island"], score, i, j).drop("__island")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), (-F.col(i).cast("long")).alias("i"), (-F.col(j).cast("long")).alias("j"))))
    grouped = candidates.groupBy(*keys).agg(ordered.alias("__c"))

    def step(kept, c):
        free = F.forall(kept, lambda k: (k["i"] != c["i"]) & (k["j"] != c["j"]))
        return F.when(free, F.concat(kept, F.array(c))).otherwise(kept)

    kept = F.aggregate("__c", F.filter("__c", lambda _: F.lit(False)), step)
    return grouped.select(*keys, F.explode(kept).alias("p")).select(*keys, (-F.col("p.i")).alias(i), (-F.col("p.j")).alias(j), (-F.col("p.s")).alias(score))


def matched_in_order(pred: Column, truth: Column, tol: float) -> Column:
    """How many of ``pred``, in order, find their nearest unused time of ``truth`` within ``tol``.

    The nearest unused one is taken if it is near enough; a nearest that is too far
    is not replaced by another. Ties go to the earlier.
    """
    return _in_order(pred, truth, tol, lambda acc: acc["hits"])


def unmatched_in_order(pred: Column, truth: Column, tol: float) -> Column:
    """The times of ``truth`` that :func:`matched_in_order` leaves."""
    return _in_order(pred, truth, tol, lambda acc: acc["left"])


def _in_order(pred: Column, truth: Column, tol: float, told) -> Column:
    start = F.struct(truth.alias("left"), F.lit(0).cast("long").alias("hits"))

    def step(acc, p):
        near = F.array_min(F.transform(acc["left"], lambda g: F.struct(F.abs(g - p).alias("d"), g.alias("g"))))
        hit = F.coalesce(near["d"] <= tol, F.lit(False))
        at = F.array_position(acc["left"], near["g"]).cast("int")
        rest = F.concat(F.slice(acc["left"], F.lit(1), at - 1), F.slice(acc["left"], at + 1, F.size(acc["left"])))
        return F.struct(F.when(hit, rest).otherwise(acc["left"]).alias("left"), (acc["hits"] + hit.cast("long")).alias("hits"))

    return F.aggregate(pred, start, step, told)


def pieces(pred: DataFrame, truth: DataFrame, keys: list[str], t: str, tol: float) -> DataFrame:
    """``keys``, ``__p`` and ``__g``: the times of both sides in order, cut where nothing follows for more than ``tol``, across which nothing matches."""
    side = lambda rows, k: rows.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(k).alias("__k")).where(F.col("__t").isNotNull())
    both = islands(side(pred, 0).unionByName(side(truth, 1)), keys, F.col("__t"), F.col("__t") + tol * (1 + 1e-9))
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("__k") == k, F.col("__t"))))
    return both.groupBy(*keys, "__island").agg(of(0).alias("__p"), of(1).alias("__g")).drop("__island")


def match_at(pred: DataFrame, truth: DataFrame, keys: list[str], t: str, tol: float) -> DataFrame:
    """Per group the numbers of predictions, truths and matches, with precision, recall and F1."""
    each = pieces(pred, truth, keys, t, tol).withColumn("tp", matched_in_order(F.col("__p"), F.col("__g"), tol))
    out = each.groupBy(*keys).agg(F.sum(F.size("__p")).alias("n_pred"), F.sum(F.size("__g")).alias("n_gt"), F.sum("tp").alias("tp"))
    precision = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    recall = F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt")).otherwise(0.0)
    out = out.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def nearest_without_replacement(left: Column, right: Column) -> Column:
    """Each of ``left`` (array of struct<score, id>), in order, takes the unused one of ``right`` with the nearest score; ties to the lower id.

    An array of struct<left, right, gap>; what finds nothing left is not in it. Both
    arrays are those of one stratum.
    """
    none = F.array().cast("array<struct<left:bigint,right:bigint,gap:double>>")
    start = F.struct(right.alias("rest"), none.alias("pairs"))

    def step(acc, x):
        near = F.array_min(F.transform(acc["rest"], lambda r: F.struct(F.abs(r["score"] - x["score"]).alias("gap"), r["id"].alias("id"))))
        pair = F.struct(x["id"].cast("long").alias("left"), near["id"].cast("long").alias("right"), near["gap"].cast("double").alias("gap"))
        return F.struct(F.filter(acc["rest"], lambda r: ~r["id"].eqNullSafe(near["id"])).alias("rest"), F.when(near.isNotNull(), F.concat(acc["pairs"], F.array(pair))).otherwise(acc["pairs"]).alias("pairs"))

    return F.aggregate(left, start, step, lambda acc: acc["pairs"])


class _Free:
    """Ids by score of which the nearest that is still free is taken; of equal gaps the lowest id."""

    def __init__(self, scores: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, scores))
        scores, self.ids = scores[order], ids[order].tolist()
        first = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]])) if len(scores) else np.empty(0, int)
        self.scores = scores[first].tolist()
        # of each score the next free id, one past its last, and where to look on if none is left (one place of margin at both ends)
        self.head, self.end = first.tolist(), [*first[1:].tolist(), len(scores)]
        self.ahead, self.back = list(range(len(first) + 2)), list(range(len(first) + 2))
        self.order = scores[first]

    @staticmethod
    def _find(to: list[int], at: int) -> int:
        root = at
        while to[root] != root:
            root = to[root]
        while to[at] != root:
            to[at], at = root, to[at]
        return root

    def places(self, x: np.ndarray) -> list[int]:
        return np.searchsorted(self.order, x).tolist()

    def take(self, x: float, place: int) -> tuple[int, float] | None:
        """The id and its gap; ``place``: of ``x`` among the scores."""
        n = len(self.scores)
        lo, hi = self._find(self.back, place), self._find(self.ahead, place + 1)
        gaps = [abs(self.scores[k - 1] - x) for k in (lo, hi) if 0 < k <= n]
        if not gaps:
            return None
        gap, best = min(gaps), None
        while lo > 0 and abs(self.scores[lo - 1] - x) == gap:  # further scores may have the same gap, rounded
            best = lo if best is None or self.ids[self.head[lo - 1]] < self.ids[self.head[best - 1]] else best
            lo = self._find(self.back, lo - 1)
        while hi <= n and abs(self.scores[hi - 1] - x) == gap:
            best = hi if best is None or self.ids[self.head[hi - 1]] < self.ids[self.head[best - 1]] else best
            hi = self._find(self.ahead, hi + 1)
        taken = self.ids[self.head[best - 1]]
        while self.head[best - 1] < self.end[best - 1] and self.ids[self.head[best - 1]] == taken:  # a repeated id goes whole
            self.head[best - 1] += 1
        if self.head[best - 1] == self.end[best - 1]:
            self.back[best], self.ahead[best] = best - 1, best + 1
        return taken, gap


def nearest_free(rows: DataFrame, key: str, row: str, score: str, chooses: str) -> DataFrame:
    """``key, left, right, gap``: :func:`nearest_without_replacement` of a table, each row that ``chooses`` in order of its id ``row``.

    The others are those it takes from; an id has one score in a stratum (``key``, which may be null). A task
    reads a stratum's rows in a stream and holds as numbers those to be taken. A free one is found by
    its place among the scores, not among all. Rows without a score are left out.
    """
    kind = dict(rows.dtypes)[key]
    held = rows.select(key, F.col(chooses).cast("int").alias("__chooses"), F.col(row).cast("long").alias("__id"), F.col(score).cast("double").alias("__score")).where("__chooses IS NOT NULL AND __id IS NOT NULL AND __score IS NOT NULL AND NOT isnan(__score)")
    dealt = held.repartition(key).sortWithinPartitions(key, "__chooses", "__id", "__score")

    def run(batches):
        at, ids, scores, free = None, [], [], None
        for pdf in batches:
            out = []
            # parts of one stratum and side; null keys are one stratum
            keys, side = pdf[key], pdf["__chooses"]
            cut = (keys.ne(keys.shift()) & ~(keys.isna() & keys.shift().isna())) | side.ne(side.shift())
            for _, part in pdf.groupby(cut.cumsum(), sort=False):
                k, mine, x = part[key].iloc[0], part["__id"].to_numpy(), part["__score"].to_numpy()
                k = None if pd.isna(k) else k
                if at != (k,):
                    at, ids, scores, free = (k,), [], [], None
                if part["__chooses"].iloc[0] == 0:
                    ids.append(mine)
                    scores.append(x)
                    continue
                if free is None:
                    free = _Free(np.concatenate([np.empty(0), *scores]), np.concatenate([np.empty(0, np.int64), *ids]))
                    ids, scores = [], []
                for i, s, place in zip(mine.tolist(), x.tolist(), free.places(x)):
                    found = free.take(s, place)
                    if found is not None:
                        out.append((k, i, *found))
            yield pd.DataFrame(out, columns=[key, "left", "right", "gap"])

    return dealt.mapInPandas(run, f"{key} {kind}, left long, right long, gap double")


def _neighbours(points: DataFrame, values: DataFrame, keys: list[str], x: str, columns: list[str]) -> DataFrame:
    """``points`` (``keys``, ``x``), each with ``__v``: the rows of ``values`` next to it, at or below and at or above, as structs of ``x`` and ``columns``. Keys may be null, ``x`` not."""
    held = F.struct(x, *columns)
    both = points.select(*keys, x, F.lit(1).alias("__left")).withColumn("__at", F.lit(None).cast(values.select(held.alias("v")).schema["v"].dataType)).unionByName(values.select(*keys, x, F.lit(0).alias("__left"), held.alias("__at")))
    # a frame that ends with the row is one pass, one that begins with it is not: the way up is the way down in falling order
    seen = [F.last("__at", ignorenulls=True).over(W.partitionBy(*keys).orderBy(order, "__left").rowsBetween(W.unboundedPreceding, 0)) for order in (F.col(x), F.col(x).desc())]
    told = both.withColumns({"__below": seen[0], "__above": seen[1]}).where("__left = 1")
    return told.select(*keys, x, F.array_compact(F.array("__below", "__above")).alias("__v"))


def nearest_controls(cases: DataFrame, controls: DataFrame, keys: list[str], x: str, y: str, row: str, control: str) -> DataFrame:
    """``row, control``: of each case the control with equal ``keys`` that is nearest by ``x``, of these by ``y``, of these the least.

    Distinct values of ``x``, and of ``y`` beside each of them, are searched in order; no case
    meets all controls. Different values are to be further apart than their gaps are rounded.
    A null ``x`` is as far from all, and further than any; rows with a null key or ``y`` are left out.
    """
    held = [*[F.col(k).isNotNull() for k in keys], F.col(y).isNotNull()]
    for known in held:
        cases, controls = cases.where(known), controls.where(known)
    kinds = cases.select(*keys, x, y).distinct()
    least = controls.groupBy(*keys, x, y).agg(F.min(control).alias("__c"))
    near = _neighbours(kinds.select(*keys, x).distinct().where(F.col(x).isNotNull()), least.select(*keys, x).distinct().where(F.col(x).isNotNull()), keys, x, [])
    gap = lambda v: F.abs(F.col(x) - v[x])
    near = near.withColumn("__least", F.array_min(F.transform("__v", gap)))
    near = near.select(*keys, x, F.explode(F.array_distinct(F.filter("__v", lambda v: gap(v) == F.col("__least")))).alias("__v")).select(*keys, F.col(x).alias("__of"), F.col(f"__v.{x}").alias("__x"))
    sought = kinds.withColumnRenamed(x, "__of").join(near, [*keys, "__of"], "left")
    # where x tells nothing, all controls of the keys are as near: they are those of a null
    every = least.groupBy(*keys, y).agg(F.min("__c").alias("__c")).withColumn("__x", F.lit(None).cast(dict(least.dtypes)[x]))
    pool = least.where(F.col(x).isNotNull()).withColumnRenamed(x, "__x").unionByName(every)
    found = _neighbours(sought.select(*keys, "__x", y).distinct(), pool, [*keys, "__x"], y, ["__c"])
    told = sought.alias("s").join(found.alias("f"), [F.col(f"s.{k}") == F.col(f"f.{k}") for k in (*keys, y)] + [F.col("s.__x").eqNullSafe(F.col("f.__x"))]).select(*[F.col(f"s.{k}") for k in (*keys, "__of", y, "__x")], F.explode("f.__v").alias("__v"))
    # a null gap comes last
    order = F.struct(F.coalesce(F.abs(F.col("__of") - F.col("__x")), F.lit(float("inf"))).alias("a"), F.abs(F.col(y) - F.col(f"__v.{y}")).alias("b"), F.col("__v.__c").alias("c"))
    best = told.groupBy(*keys, "__of", y).agg(F.min(order).alias("__best"))
    out = cases.alias("c").join(best.alias("b"), [F.col(f"c.{k}") == F.col(f"b.{k}") for k in (*keys, y)] + [F.col(f"c.{x}").eqNullSafe(F.col("b.__of"))])
    return out.groupBy(F.col(f"c.{row}").alias(row)).agg(F.min("b.__best").alias("__best")).select(row, F.col("__best.c").alias(control))
