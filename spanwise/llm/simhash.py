"""SimHash fingerprints of documents and their near duplicates by a binary trie self-join.

A fingerprint's 64 bits are cut into four blocks; of two fingerprints with at most
three differing bits one block agrees, and of the 48 other bits, cut into four
again, one part of 12. Each fingerprint is therefore dealt out sixteen times by
28 bits that a partner shares in at least one deal. Within a task the fingerprints
of one such prefix form a binary trie over the other 36 bits: pairs of nodes are
taken down together, a pair's error grows by one where its sides take different
branches, and pairs over three errors are pruned. Pairs whose leaves already hang
together are pruned too, so a large group of near copies costs a spanning forest,
not all its pairs. Nothing that could link is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected
from .shared import cut, tidy
from .token_store import slices

SEED = 42
ERRORS = 3
#: Node pairs that are taken down a level at once, and pairs of leaves below which a pair of nodes is compared outright.
FRONTIER, OUTRIGHT = 1 << 16, 16
#: Fingerprints (times sixteen deals) that one task joins.
DEALT_PER_TASK = 2_000_000
#: Fingerprints with one prefix of a deal that one task joins.
MOST_ROWS = 500_000


def fingerprints(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text; 0 for one without words."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes, sizes, where = [], [], []
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        joined, n = b" ".join(words), len(words)
        width = min(shingle, n)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
        starts = [0, *(e + 1 for e in ends[: n - width])]
        hashes.append([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])])
        sizes.append(n - width + 1)
        where.append(k)
    if not where:
        return out
    h = np.fromiter(chain.from_iterable(hashes), np.uint64, sum(sizes))
    n = np.array(sizes)
    step, counts = 1 << 16, np.zeros((len(n), 64), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(h), step):
        part, mine = h[at : at + step], owner[at : at + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        counts[mine[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    out[where] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints(part.column(1).to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return run


def fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` of each document, fp as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint(shingle), "doc_id long, fp long")


def _moved(x: np.ndarray, total: int, width: int, k: int) -> np.ndarray:
    """Of ``total`` low bits, the ``k``-th part of ``width`` bits from the top moved to the top."""
    low = total - width * (k + 1)
    part = (x >> np.uint64(low)) & np.uint64((1 << width) - 1)
    high = x >> np.uint64(low + width)
    return (part << np.uint64(total - width)) | (high << np.uint64(low)) | (x & np.uint64((1 << low) - 1))


def _moved_back(x: np.ndarray, total: int, width: int, k: int) -> np.ndarray:
    low = total - width * (k + 1)
    part, rest = x >> np.uint64(total - width), x & np.uint64((1 << (total - width)) - 1)
    high = rest >> np.uint64(low)
    return (high << np.uint64(low + width)) | (part << np.uint64(low)) | (rest & np.uint64((1 << low) - 1))


REST = np.uint64((1 << 48) - 1)


def deal(fp: np.ndarray, k: int) -> np.ndarray:
    """The bits of each fingerprint in the order of deal ``k``; its first 28 are the prefix."""
    x = _moved(fp, 64, 16, k // 4)
    return (x & ~REST) | _moved(x & REST, 48, 12, k % 4)


def undeal(x: np.ndarray, k: int) -> np.ndarray:
    return _moved_back((x & ~REST) | _moved_back(x & REST, 48, 12, k % 4), 64, 16, k // 4)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(16):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(deal(fp, k).view(np.int64))], names=["k", "bits"])


def trie_links(x: np.ndarray, depth: int = 28, errors: int = ERRORS) -> Forest:
    """Links among sorted distinct ``x`` that agree in their first ``depth`` bits and differ in at most ``errors``.

    Returns a forest over the positions of ``x`` with the components of these links.
    """
    forest = Forest(len(x))
    prefix = x >> np.uint64(64 - depth)
    lo = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(x) else np.empty(0, np.int64)
    hi = np.append(lo[1:], len(x)) if len(x) else lo
    several = hi - lo > 1
    lo, hi = lo[several], hi[several]
    #: Node pairs as columns: first node's bounds, second node's bounds, errors so far.
    stack = [(depth, np.stack([lo[i : i + FRONTIER], hi[i : i + FRONTIER], lo[i : i + FRONTIER], hi[i : i + FRONTIER], np.zeros(len(lo[i : i + FRONTIER]), np.int64)])) for i in range(0, len(lo), FRONTIER)]
    changes = None
    while stack:
        d, pairs = stack.pop()
        if changes is None:
            root = forest.roots()
            changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        a, b, c, e, err = pairs
        one = (changes[b - 1] == changes[a]) & (changes[e - 1] == changes[c]) & (forest.parent[a] == forest.parent[c])
        pairs = pairs[:, ~one]
        a, b, c, e, err = pairs
        near = err + (64 - d) <= errors  # all bits that are left may differ
        if near.any():
            for i, j, k, m in zip(a[near], b[near], c[near], e[near]):
                forest.link(np.concatenate([np.arange(i, j), np.arange(k, m)]), np.full(j - i + m - k, i))
            changes = None
        few = ~near & ((b - a) * (e - c) <= OUTRIGHT)
        if few.any():
            na, nb = (b - a)[few], (e - c)[few]
            n = na * nb
            base = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
            i, j = a[few][base] + at // nb[base], c[few][base] + at % nb[base]
            hit = np.bitwise_count(x[i] ^ x[j]) <= errors
            hit &= i < j
            if hit.any():
                forest.link(i[hit], j[hit])
                changes = None
        pairs = pairs[:, ~near & ~few]
        if not pairs.shape[1]:
            continue
        a, b, c, e, err = pairs
        bit = np.uint64(1 << (63 - d))
        keep = ~np.uint64((1 << (64 - d)) - 1)
        am = np.clip(np.searchsorted(x, (x[a] & keep) | bit), a, b)
        cm = np.clip(np.searchsorted(x, (x[c] & keep) | bit), c, e)
        same = a == c
        other = ~same
        children = [
            np.stack([a, am, c, cm, err]),
            np.stack([am, b, cm, e, err]),
            np.stack([a, am, cm, e, err + 1]),
            np.stack([am, b, c, cm, err + 1])[:, other],
        ]
        down = np.concatenate(children, axis=1)
        down = down[:, (down[1] > down[0]) & (down[3] > down[2]) & (down[4] <= errors)]
        down = down[:, ~((down[0] == down[2]) & (down[1] - down[0] == 1))]  # a leaf with itself
        down = down[:, np.argsort(-down[4], kind="stable")]  # what agrees so far comes off the stack first
        stack += [(d + 1, down[:, i : i + FRONTIER]) for i in range(0, down.shape[1], FRONTIER)]
    return forest


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    deals, bits = (np.concatenate(x) for x in zip(*parts))
    for k in np.unique(deals).tolist():
        x = np.unique(bits[deals == k].view(np.uint64))
        root = trie_links(x).roots()
        child = np.flatnonzero(root != np.arange(len(x)))
        tidy()
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(undeal(x[child], k).view(np.int64)), pa.array(undeal(x[root[child]], k).view(np.int64))], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints (column ``fp``) with the components of all pairs at most three bits apart.

    A prefix that more than ``MOST_ROWS`` fingerprints share is dealt into blocks, of
    which every two meet in a task.
    """
    n = fps.count()
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * 16 // DEALT_PER_TASK))
    prefix, zero = F.shiftrightunsigned("bits", 36).alias("prefix"), F.lit(0).cast("long")
    dealt = fps.select("fp").mapInArrow(_dealt, "k int, bits long").select("k", "bits", prefix, zero.alias("cell"))
    if n > MOST_ROWS:  # else no prefix can have more
        crowded = cut(dealt.groupBy("k", "prefix").count().where(F.col("count") > MOST_ROWS).select("k", "prefix", F.ceil(F.col("count") / (MOST_ROWS / 2)).alias("blocks")), "simhash-crowded")
        mine = F.pmod(F.xxhash64("bits"), F.col("blocks"))
        met = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine))
        dealt = dealt.drop("cell").join(crowded, ["k", "prefix"], "left").select("k", "bits", "prefix", F.explode(F.coalesce(met, F.array(zero))).alias("cell"))
    return dealt.repartition(tasks, "k", "prefix", "cell").select("k", "bits").mapInArrow(_joined, "a long, b long")


def _named(fps: DataFrame) -> DataFrame:
    """``fp, label, component_id`` of each distinct fingerprint of ``fps`` (doc_id, fp): its group, and the group's least ``doc_id``."""
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    component = connected(links(classes)).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    labelled = classes.join(component, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs``.

    Words are what ASCII white space separates, A-Z lower-cased; shingles are
    ``shingle`` words (all words of a shorter text), repeats included. Null text is
    empty; texts without words have fingerprint zero and link like any other.
    Rows that repeat a ``doc_id`` are kept. A null ``doc_id`` never names a
    component unless all its documents have none. Other columns are ignored.
    """
    fps = cut(fingerprint(docs, shingle), "simhash")
    return fps.join(_named(fps), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
