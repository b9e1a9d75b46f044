"""Exact links within groups of sets: a spanning forest of the pairs at a Jaccard similarity or more.

A group is searched breadth first. The member at hand is compared with all members that
nothing links yet, by the exact similarity; those that are similar enough are linked and
searched from in turn. So only links that hold save comparisons, and the links found
connect exactly what all pairs would connect. Two sets at similarity t share one of
the rarest ``|x| - ceil(t |x|) + 1`` members of each, which spares most comparisons in
groups whose members are merely alike.

A group that is too large for one task is dealt into blocks. First each block is
searched with one member of every other block beside it. What then hangs together with
most of the group needs no further comparison among itself; the others (often few)
are dealt into blocks too, and each of these meets every block of the group. So every pair is
compared or already connected, and the result does not depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .components import connected
from .shared import cut, tidy

#: Members, and bytes of sets, of a block.
MOST_MEMBERS, MOST_BYTES = 2048, 1 << 23


def similarity(both: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the sizes of an intersection and of two sets; that of two empty ones is 1."""
    return np.where((x == 0) & (y == 0), 1.0, both / np.maximum(1, x + y - both))


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of each run."""
    return np.repeat(starts, sizes) + tn.within(sizes)


class Group:
    """Sets of hashes (``flat[bounds[k]:bounds[k + 1]]``) of one group, by the rarity of their members in it."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, threshold: float):
        self.size, self.start, self.threshold = np.diff(bounds), bounds[:-1], threshold
        _, code, freq = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(freq), np.int64)
        rank[np.argsort(freq, kind="stable")] = np.arange(len(freq))
        owner = np.repeat(np.arange(len(self.size)), self.size)
        code = rank[code.ravel()]
        self.code = code[np.lexsort((code, owner))]  # each set in order, the rarest first
        self.prefix = np.where(self.size > 0, self.size - np.ceil(threshold * self.size - 1e-9).astype(np.int64) + 1, 0)
        self.mark = np.zeros(len(freq), bool)
        self.index(np.ones(len(self.size), bool))

    def index(self, open_: np.ndarray) -> None:
        """Lists of the sets in ``open_`` by the members of their prefixes."""
        k = np.flatnonzero(open_)
        code = self.code[_gathered(self.start[k], self.prefix[k])]
        order = np.argsort(code, kind="stable")
        self.listed, self.holder, self.indexed = code[order], np.repeat(k, self.prefix[k])[order], len(k)

    def similar(self, k: int, open_: np.ndarray) -> np.ndarray:
        """Those of ``open_`` (a flag a set) that are similar enough to set ``k``."""
        if not self.size[k]:
            return np.flatnonzero(open_ & (self.size == 0))
        own = self.code[self.start[k] : self.start[k] + self.size[k]]
        head = own[: self.prefix[k]]
        lo, hi = np.searchsorted(self.listed, head), np.searchsorted(self.listed, head, "right")
        near = self.holder[_gathered(lo, hi - lo)]
        near = np.unique(near[open_[near]])
        n = self.size[near]
        near = near[np.minimum(n, self.size[k]) >= self.threshold * np.maximum(n, self.size[k]) - 1e-9]
        if not len(near):
            return near
        n = self.size[near]
        self.mark[own] = True
        both = np.add.reduceat(self.mark[self.code[_gathered(self.start[near], n)]], np.cumsum(n) - n, dtype=np.int64)
        self.mark[own] = False
        return near[similarity(both, n, self.size[k]) >= self.threshold]


def links(flat: np.ndarray, bounds: np.ndarray, threshold: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places of sets) that connect what all pairs of at least ``threshold`` connect; sets of equal ``label`` are connected already."""
    n = len(bounds) - 1
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1].ravel()
    if label.max(initial=0) == 0 and n > 1:
        return []
    if n == 2:
        a, b = flat[: bounds[1]], flat[bounds[1] :]
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if similarity(np.array(both), np.array(len(a)), np.array(len(b))) >= threshold else []
    group = Group(flat, bounds, threshold)
    by_label = np.argsort(label, kind="stable")
    first = np.searchsorted(label[by_label], np.arange(label.max(initial=0) + 2))
    open_ = np.ones(n, bool)
    found: list[tuple[int, int]] = []
    # small labels first: when a large one is reached, little is open beside it
    for seed in np.argsort(np.diff(first), kind="stable").tolist():
        mates = by_label[first[seed] : first[seed + 1]]
        if not open_[mates[0]]:
            continue
        open_[mates] = False
        left, at = int(open_.sum()), 0
        queue = mates.tolist()
        while at < len(queue) and left:
            k = queue[at]
            at += 1
            if 2 * left < group.indexed:
                group.index(open_)
            for j in group.similar(k, open_).tolist():
                if open_[j]:
                    found.append((k, j))
                    mates = by_label[first[label[j]] : first[label[j] + 1]]
                    open_[mates] = False
                    queue += mates.tolist()
            left = int(open_.sum())
        if not left:
            break
    return found


CELL = ("component", "x", "y")


def _resolved(threshold: float):
    """Rows in order of their cell (``component, x, y, text_key, label, held``) to ``a, b, large``; one cell is held at a time."""

    def told(keys: list[int], labels: list[int], held: list[bytes], large: bool) -> pa.RecordBatch | None:
        key, at = np.unique(np.array(keys, np.int64), return_index=True)  # a member may be there as one of both sides
        if len(key) < 2:
            return None
        mine = [held[i] for i in at.tolist()]
        bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in mine])]).astype(np.int64)
        got = links(np.frombuffer(b"".join(mine), "<u8"), bounds, threshold, np.array(labels, np.int64)[at])
        if not got:
            return None
        a, b = (key[list(x)] for x in zip(*got))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([large] * len(a), pa.bool_())], names=["a", "b", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, ([], [], [])
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in CELL)))
            columns = [batch.column(c).to_pylist() for c in ("text_key", "label", "held")]
            for i, at in enumerate(where):
                if at != cell:
                    if len(rows[0]) > 1 and (out := told(*rows, cell[1] >= 0)):
                        yield out
                    cell, rows = at, ([], [], [])
                for to, column in zip(rows, columns):
                    to.append(column[i])
        if len(rows[0]) > 1 and (out := told(*rows, cell[1] >= 0)):
            yield out
        tidy()

    return run


def _searched(rows: DataFrame, threshold: float) -> DataFrame:
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.select(*CELL, "text_key", "label", "held").repartition(tasks, *CELL).sortWithinPartitions(*CELL)
    return dealt.mapInArrow(_resolved(threshold), "a long, b long, large boolean")


def _block(blocks: str, salt: int):
    return F.pmod(F.xxhash64("text_key", F.lit(salt)), F.col(blocks)).cast("int")


def _blocks_of(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Groups and the blocks that they need."""
    need = F.ceil(F.greatest(F.count(F.lit(1)) / MOST_MEMBERS, F.sum(F.length("held")) / MOST_BYTES))
    return rows.groupBy(*keys).agg(need.cast("int").alias(name))


def resolved(members: DataFrame, threshold: float) -> DataFrame:
    """``node, component`` of the members that exact links connect.

    ``members``: ``component, text_key, held``, a distinct ``text_key`` and the bytes of
    its sorted 64-bit hashes; links are sought within each component. Members without
    links are not listed. ``members`` is read several times and should be a table.
    """
    none = F.lit(-1)
    large = cut(_blocks_of(members, ["component"], "blocks").where("blocks > 1"), "resolve-large")
    small = members.join(large, "component", "left_anti").select("component", none.alias("x"), none.alias("y"), "text_key", F.col("text_key").alias("label"), "held")
    if large.isEmpty():  # nothing is dealt into blocks
        return connected(_searched(small, threshold))
    placed = cut(members.join(large, "component").withColumn("block", _block("blocks", 1)), "resolve-placed")
    alone = placed.select("component", F.col("block").alias("x"), F.lit(0).alias("y"), "text_key", F.col("text_key").alias("label"), "held")
    # one member of each block stands in every other block
    first = placed.groupBy("component", "block").agg(F.min("text_key").alias("text_key"))
    guests = placed.join(first, ["component", "block", "text_key"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("x <> block")
    guests = guests.select("component", "x", F.lit(0).alias("y"), "text_key", F.col("text_key").alias("label"), "held")
    found = cut(_searched(small.unionByName(alone).unionByName(guests), threshold), "resolve-links")
    known = connected(found.where("large")).select(F.col("node").alias("text_key"), F.col("component").alias("label"))
    labelled = cut(placed.join(known, "text_key", "left").withColumn("label", F.coalesce("label", "text_key")), "resolve-labelled")
    most = labelled.groupBy("component", "label").count().groupBy("component").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    strays = labelled.join(most, "component").where(F.col("label") != F.col("main")).drop("main")
    dealt = cut(_blocks_of(strays, ["component"], "stray_blocks"), "resolve-strays")
    sides = [
        strays.join(dealt, "component").withColumn("x", _block("stray_blocks", 2)).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))),
        labelled.join(dealt, "component").withColumn("y", F.col("block")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1))),
    ]
    both = sides[0].select(*CELL, "text_key", "label", "held").unionByName(sides[1].select(*CELL, "text_key", "label", "held"))
    again = cut(_searched(both, threshold), "resolve-links")
    return connected(found.select("a", "b").unionByName(again.select("a", "b")))
