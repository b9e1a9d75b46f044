"""Near duplicates among vectors by a forest of random-projection trees.

Every tree splits at a place of a random direction, again and again; a vector within
a margin of the split goes down both sides, so that few near pairs part. A node
splits near its median, but where few vectors lie if its vectors lie in heaps; a node
many of whose pairs are linked is not split at all. Splits are fitted on a bounded
sample; where that is spent, a node goes on splitting along further directions by
the last sample there was, so that the depth, and with it the number of trees, grows
with the table and leaves do not. In a leaf all vectors are compared in double
precision by blocks, so links are exact and none lies below the threshold. A leaf
that stays large (a heap) is dealt into blocks and every two of them meet in a task
of their own. Of the leaves that a pair shares only the first counts it, which the
vectors' leaf numbers tell without a shuffle of pairs: a task returns link counts,
and the links of a spanning forest.

Equal vectors are one class throughout; a class with c copies adds c - 1 to each of
its members' links.

Defined cases: a vector that is null, zero or holds a null or non-finite component
links with nothing, not even its copies; vectors of different lengths never link;
rows that repeat a ``vec_id`` are each answered and count as other vectors; a null
``vec_id`` never names a component; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .components import Forest, connected
from .shared import cut, sent, tidy

THRESHOLD = 0.9
#: Vectors that the trees are fitted on at most, vectors wanted in a leaf, and vectors of a sample that a node is fitted on at least.
SAMPLE, LEAF, LEAST = 40_000, 800, 64
#: Distance from the split within which a vector goes down both sides; the projections of all unit vectors have a spread of 1.
SPILL = 0.2
#: Share of the linked pairs at the threshold that a split leaves together, and the share of links that may be lost: they set the number of trees.
TOGETHER, LOST = 0.96, 0.002
#: Share of linked pairs from which a node is not split.
DENSE = 0.5
#: Vectors of a leaf beyond which it is dealt into blocks.
MOST_ROWS = 8192
SEED = 11
BLOCK = 1024

SPLIT, TAIL, END = 0, 1, 2


@dataclass
class Tree:
    directions: np.ndarray  # a row a level
    kind: np.ndarray  # of each node: SPLIT, TAIL (goes on without nodes of its own) or END
    at: np.ndarray  # node x level: where it splits
    left: np.ndarray
    right: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def place_of(p: np.ndarray) -> float:
    """Where to split projections: the median, or a place between the quantiles 0.3 and 0.7 with far fewer of them around."""
    tried = np.quantile(p, np.linspace(0.3, 0.7, 9))
    p = np.sort(p)
    near = np.searchsorted(p, tried + 2 * SPILL) - np.searchsorted(p, tried - 2 * SPILL)
    best = int(np.argmin(near))
    return float(tried[best] if near[best] < 0.7 * near[4] else tried[4])


def dense(x: np.ndarray, threshold: float) -> bool:
    """Whether many pairs of the vectors, judged by up to 200 of them, are linked."""
    x = x[:: max(1, len(x) // 200)]
    n = len(x)
    return n >= 8 and (int((x @ x.T >= threshold).sum()) - n) >= DENSE * n * (n - 1)


def grow(sample: np.ndarray, depth: int, seed: int, threshold: float = THRESHOLD) -> Tree:
    """A tree on unit vectors, ``depth`` levels deep."""
    directions = np.random.default_rng(seed).normal(size=(depth, sample.shape[1]))
    p = sample @ directions.T
    kind, at, left, right = [], [], [], []

    def add(rows: np.ndarray, level: int) -> int:
        node = len(kind)
        kind.append(END)
        at.append(np.zeros(depth))
        left.append(node)
        right.append(node)
        if level == depth or len(rows) and dense(sample[rows], threshold):
            return node
        if len(rows) < LEAST:
            kind[node] = TAIL
            if len(rows):
                at[node][level:] = np.median(p[rows, level:], axis=0)
            return node
        kind[node] = SPLIT
        at[node][level] = place = place_of(p[rows, level])
        left[node] = add(rows[p[rows, level] <= place], level + 1)
        right[node] = add(rows[p[rows, level] > place], level + 1)
        return node

    add(np.arange(len(sample)), 0)
    return Tree(directions, np.array(kind), np.array(at).reshape(len(kind), depth), np.array(left), np.array(right))


def leaves(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row and leaf number (its path from the root, after a leading one); a row can be in several leaves."""
    p = x @ tree.directions.T
    row, node, path = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(p.shape[1]):
        end = tree.kind[node] == END
        done.append((row[end], path[end]))
        row, node, path = row[~end], node[~end], path[~end]
        off = p[row, level] - tree.at[node, level]
        down, up = off <= SPILL, off >= -SPILL
        row, node, path = np.concatenate([row[down], row[up]]), np.concatenate([tree.left[node[down]], tree.right[node[up]]]), np.concatenate([2 * path[down], 2 * path[up] + 1])
    done.append((row, path))
    return tuple(np.concatenate(c) for c in zip(*done))


def _array(vectors: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "<f8").reshape(-1, width)


def _placed(forests):
    """The numbers of each vector's leaves, in order; a tree's stand above 48 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                widths = np.array(part.column("width").to_pylist())
                for width in np.unique(widths).tolist():
                    mine = part.filter(pa.array(widths == width))
                    x = unit(_array(mine.column("vector"), width))
                    rows, paths = zip(*(leaves(tree, x) for tree in forests.value[width]))
                    row, path = np.concatenate(rows), np.concatenate([t << 48 | q for t, q in enumerate(paths)])
                    order = np.lexsort((path, row))
                    bounds = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(path[order]))], names=[*mine.schema.names, "leaves"])

    return run


def _shared(i: np.ndarray, j: np.ndarray, padded: np.ndarray) -> np.ndarray:
    """Whether vectors i[k] and j[k] are together in a leaf that comes before; ``padded``: a row a vector, -1 where there is none."""
    out = np.zeros(len(i), bool)
    for k in range(padded.shape[1]):
        left = padded[i, k]
        out |= ((padded[j] == left[:, None]) & (left >= 0)[:, None]).any(axis=1)
    return out


def compare(x: np.ndarray, earlier: list[np.ndarray], copies: np.ndarray, threshold: float, first: int | None = None) -> tuple[np.ndarray, Forest]:
    """Links of each of the unit vectors ``x`` to others that no leaf before holds together with it, and their forest.

    ``first``: only pairs of one of the first so many vectors and one of the others.
    Vectors that share the commonest leaf before stand together and are not compared.
    """
    n = len(x)
    sizes = np.array([len(e) for e in earlier], np.int64)
    padded = np.full((n, int(sizes.max(initial=0))), -1, np.int64)
    padded[np.repeat(np.arange(n), sizes), tn.within(sizes)] = np.concatenate(earlier) if n else 0
    side = np.zeros(n, np.int64) if first is None else (np.arange(n) >= first).astype(np.int64)
    known = np.zeros(n, bool)
    codes, times = np.unique(padded[padded >= 0], return_counts=True)
    if len(codes):
        known = (padded == codes[np.argmax(times)]).any(axis=1)
    order = np.lexsort((~known, side))
    x, padded, weight, side, known = x[order], padded[order], copies[order], side[order], known[order]
    links, forest = np.zeros(n, np.int64), Forest(n)
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            s, t = slice(a, a + BLOCK), slice(b, b + BLOCK)
            if known[s].all() and known[t].all() or first is not None and side[s][0] == side[t][-1]:
                continue
            hit = x[s] @ x[t].T >= threshold
            if a == b:
                hit = np.triu(hit, 1)
            if first is not None:
                hit &= side[s, None] != side[None, t]
            hit &= ~(known[s, None] & known[None, t])
            i, j = np.nonzero(hit)
            for k in range(0, len(i), 1 << 18):
                p, q = i[k : k + (1 << 18)] + a, j[k : k + (1 << 18)] + b
                fresh = ~_shared(p, q, padded)
                p, q = p[fresh], q[fresh]
                links += np.bincount(p, weight[q], n).astype(np.int64) + np.bincount(q, weight[p], n).astype(np.int64)
                root = forest.roots()
                apart = root[p] != root[q]
                forest.link(p[apart], q[apart])
    out, root = np.empty(n, np.int64), forest.roots()
    out[order] = links
    back = Forest(n)
    back.link(order, order[root])
    return out, back


def _linked(threshold: float):
    types = pa.schema([("class", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        table = table.sort_by([("block", "ascending"), ("class", "ascending")])
        block = table.column("block").to_numpy()
        first = int((block == block[0]).sum()) if table.column("across")[0].as_py() else None
        ids, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        if first == len(ids):  # the other block is empty
            return types.empty_table()
        x = unit(_array(table.column("vector").combine_chunks(), width))
        links, forest = compare(x, [np.array(e, np.int64) for e in table.column("earlier").to_pylist()], copies, threshold, first)
        some = np.flatnonzero(links)
        tidy()
        return pa.table([pa.array(ids[some]), pa.array(ids[forest.roots()[some]]), pa.array(links[some])], schema=types)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where they link with nothing."""
    for batch in batches:
        vectors, widths = [], []
        for v in batch.column(1):
            values = None if not v.is_valid else v.values
            x = None if values is None or values.null_count or not len(values) else values.to_numpy(zero_copy_only=False).astype("<f8")
            ok = x is not None and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
            vectors.append((x + 0.0).tobytes() if ok else None)  # -0.0 becomes 0.0
            widths.append(len(x) if ok else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary()), pa.array(widths, pa.int32())], names=["vec_id", "vector", "width"])


def trees_for(depth: int) -> int:
    """How many trees of this depth leave at most ``LOST`` of the pairs at the threshold apart in all of them."""
    return max(1, int(np.ceil(np.log(LOST) / np.log(1 - min(TOGETHER**depth, 1 - 1e-9)))))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, leaf: int = LEAF, most_rows: int = MOST_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``embeddings`` (vec_id, embedding).

    ``n_links`` counts the other rows at a cosine of ``threshold`` or more that a
    leaf holds together with the row's; ``component_id`` is the least ``vec_id``
    that links lead to.
    """
    spark = embeddings.sparkSession
    rows = cut(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_packed, "vec_id long, vector binary, width int").withColumn("digest", F.sha2("vector", 256)), "embed-rows")
    # a class's number is a hash of its vector, one of two colliding digests in 2^32 classes
    good = rows.where("vector IS NOT NULL").withColumn("class", F.xxhash64("digest", "vector"))
    classes = cut(good.groupBy("class", "digest", "width").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "embed-classes")
    forests: dict[int, list[Tree]] = {}
    for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect():
        depth = max(0, int(np.ceil(np.log2(max(1, r["n"] / leaf)))))
        share = min(1.0, sample / r["n"])
        taken = classes.where((F.col("width") == r["width"]) & (F.shiftrightunsigned("class", 11) / float(1 << 53) <= share)).select("class", "vector").limit(sample + sample // 8).collect()
        taken.sort(key=lambda t: t["class"])
        x = unit(np.frombuffer(b"".join(bytes(t["vector"]) for t in taken), "<f8").reshape(-1, r["width"])) if taken else np.zeros((0, r["width"]))
        forests[r["width"]] = [grow(x, depth, SEED + t, threshold) for t in range(trees_for(depth))]
    if not forests:
        forests[0] = []
    with sent(spark, forests) as held:
        placed = cut(classes.select("class", "width", "vector", "copies").mapInArrow(_placed(held), "class long, width int, vector binary, copies long, leaves array<long>"), "embed-leaves")
    # leaves over most_rows: their rows are dealt into blocks, a row of each goes to every pair of its block
    crowded = cut(placed.select("width", F.explode("leaves").alias("leaf")).groupBy("width", "leaf").count().where(F.col("count") > most_rows).select("width", "leaf", F.ceil(F.col("count") * 2 / most_rows).alias("blocks")), "embed-crowded")
    dealt = placed.select("class", "width", "vector", "copies", "leaves", F.posexplode("leaves").alias("k", "leaf")).withColumn("earlier", F.slice("leaves", 1, F.col("k"))).drop("leaves", "k")
    dealt = dealt.join(crowded, ["width", "leaf"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("class", "leaf"), F.col("blocks")), F.lit(0).cast("long")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks") - 1, F.lit(0).cast("long")))))
    dealt = dealt.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).withColumn("across", F.col("one") != F.col("two"))
    linked = cut(dealt.select("width", "leaf", "one", "two", "block", "across", "class", "vector", "earlier", "copies").groupBy("width", "leaf", "one", "two").applyInArrow(_linked(threshold), "class long, root long, links long"), "embed-links")
    component = connected(linked.select(F.col("class").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("class"), F.col("component").alias("label"))
    total = linked.groupBy("class").agg(F.sum("links").alias("links"))
    labelled = classes.select("class", "least", "copies").join(total, "class", "left").join(component, "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    answered = good.select("vec_id", "class").join(named, "class").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return answered.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
