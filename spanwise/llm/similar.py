"""Near duplicates of texts at a Jaccard similarity of 0.8 over five-word shingles, by SimHash.

A text's fingerprint has 256 bits over its distinct shingles. Two texts at the
threshold differ in 39 bits on average and in more than the last of ``LEVELS`` almost never, too
many for blocks that agree whole. Each fingerprint is therefore dealt out many
times, each time by a prefix of bits drawn at random, which a partner at the
threshold shares in some of the deals. Within a prefix a binary trie over
``BITS`` further bits is joined with itself: node pairs go down together, a pair's
error grows by one where its sides take different branches, and pairs over
``ERRORS`` are pruned, as are pairs whose leaves hang together already. What reaches
the leaves is compared in all bits. The join runs with a budget that grows, so that
the links kept are those of a spanning forest of the nearest pairs.

The forests of all prefixes together tell which texts might belong together: every
near pair lies within one of these groups, whichever of its pairs stand in a
forest. Within a group the exact similarity of shingle sets decides alone
(:mod:`.resolve`): links of 0.8 or more connect, and only these save comparisons. So the
result is that of all pairs within the groups, however prefixes or groups are dealt into blocks.
The number of bits of a prefix grows with the logarithm of the number of
distinct texts, and that of deals by as much as keeps the recall.

Words are what ASCII white space separates, A-Z lower-cased; the only shingle of a
text of fewer than five words is all its words. Texts that are equal in their words
are copies and one class from the start.

Defined cases: null text is empty; texts without words are copies of each other;
rows that repeat or have no ``doc_id`` are told apart by their text; an empty table
gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .components import Forest, connected
from .resolve import resolved
from .shared import cut, row_key, scratch, tidy
from .token_store import slices

SHINGLE, SIMILARITY = 5, 0.8
WIDTH = 256
#: Bits of the trie below a prefix, and errors that a pair may have in these.
BITS, ERRORS = 16, 3
#: Deals for a prefix of eight bits, and the share of a threshold pair's bits that agree: each further bit takes more deals.
DEALS, AGREE = 24, 0.8485
#: Distinct texts that share a prefix, about.
SHARING = 1000
#: Differing bits of all 256 that are allowed, from pass to pass.
LEVELS = (24, 36, 46, 56)
#: Pairs below which the leaves of two nodes are compared outright, node pairs that are taken down at once, rows and pairs that are compared at once.
OUTRIGHT, FRONTIER, ROWS, COMPARED = 1 << 14, 1 << 14, 512, 1 << 16
#: Rows of a prefix all of whose near pairs are held at once, and pairs of several such prefixes.
SMALL, PAIRS = 1024, 1 << 23
#: Rows of one prefix that one task joins; more are dealt into blocks, and every two blocks meet.
MOST_ROWS = 200_000
SEED = 23


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each text (one more: the end)."""
    cp, starts = tn.points(texts)
    cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    a, b = tn.runs((cp != 32) & ((cp < 9) | (cp > 13)))
    return tn.hashes(tn.mixed(cp), a, b), tn.per_text(a, starts)


def shingles(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, in order within each; the first of each text, and the end; a hash of all words of each."""
    word, bounds = _words(texts)
    count = np.diff(bounds)
    whole = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(count)
    whole[some] = tn.mixed(tn.hashes(word, bounds[some], bounds[some + 1]))
    long = np.flatnonzero(count >= n)
    key, owner = tn.ngrams(word, bounds[long], count[long], n)
    short = np.flatnonzero((count > 0) & (count < n))
    key, owner = np.concatenate([key, whole[short]]), np.concatenate([long[owner], short])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[fresh], owner[fresh]
    return key, np.searchsorted(owner, np.arange(len(texts) + 1)), whole


#: A byte's bits, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The 256-bit SimHash of each text as four unsigned longs; zeros without shingles.

    Bits are counted eight at a time, a byte each, over at most 255 shingles at once.
    """
    n = np.diff(bounds)
    pieces = -(-n // 255)
    edge = np.repeat(bounds[:-1], pieces) + tn.within(pieces) * 255
    text = np.repeat(np.arange(len(n)), pieces)
    out = np.zeros((len(n), WIDTH // 64), np.uint64)
    if not len(edge):
        return out
    first = np.flatnonzero(np.diff(text, prepend=-1))
    some = text[first]
    for k in range(WIDTH // 64):
        byte = np.ascontiguousarray(tn.mixed(key ^ np.uint64(0x9E37 + k))).view(np.uint8).reshape(-1, 8)
        ones = np.empty((len(edge), 8), "<u8")
        for c in range(8):
            ones[:, c] = np.add.reduceat(_LANES[byte[:, c]], edge)
        count = np.add.reduceat(ones.view(np.uint8).reshape(len(edge), 64), first, axis=0, dtype=np.int64)
        out[some, k] = np.packbits(count * 2 > n[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


PRINTS = "key long, doc_id long, text_key long, f0 long, f1 long, f2 long, f3 long"
PARTS = ("f0", "f1", "f2", "f3")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            key, bounds, whole = shingles([t or "" for t in part.column(2).to_pylist()])
            fp = fingerprints(key, bounds).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(whole.view(np.int64)), *(pa.array(c) for c in fp.T)], names=["key", "doc_id", "text_key", *PARTS])


def _drawn(deals: int) -> list[np.ndarray]:
    """The places of the bits of each deal, in order."""
    rng = np.random.default_rng(SEED)
    return [rng.permutation(WIDTH) for _ in range(deals)]


def _number(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as numbers, the first bit highest."""
    out = np.zeros(len(bits), np.int64)
    for column in bits.T:
        out = out << 1 | column
    return out


DEALT = "deal int, prefix long, bits int, text_key long, f0 long, f1 long, f2 long, f3 long"


def _dealt(prefix: int, deals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _drawn(deals)
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                fp = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in PARTS], axis=1)
                bits = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
                for k, p in enumerate(places):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fp), k, np.int32)), pa.array(_number(bits[:, p[:prefix]])), pa.array(_number(bits[:, p[prefix : prefix + BITS]]).astype(np.int32)), part.column("text_key"), *(part.column(c) for c in PARTS)],
                        names=["deal", "prefix", "bits", "text_key", *PARTS],
                    )

    return run


def forest_edges(forest: Forest, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of the pairs i[k], j[k] those that a least spanning forest takes up, by ``d`` and then order; they are linked."""
    taken = []
    left = np.lexsort((j, i, d))
    while len(left):
        root = forest.roots()
        left = left[root[i[left]] != root[j[left]]]
        if not len(left):
            break
        # each tree's least pair
        ends = np.stack([root[i[left]], root[j[left]]], axis=1).ravel()
        _, first = np.unique(ends, return_index=True)
        least = left[np.unique(first // 2)]
        forest.link(i[least], j[least])
        taken.append(least)
    return np.concatenate(taken) if taken else np.empty(0, np.int64)


class Trie:
    """A trie over the last ``BITS`` bits of sorted ``node``, below a number for the prefix; ``fp``: the fingerprints."""

    def __init__(self, node: np.ndarray, fp: np.ndarray):
        self.node, self.fp = node, fp
        self.low = (node & ((1 << BITS) - 1)).astype(np.uint16)
        self.forest = Forest(len(node))
        group = node >> BITS
        self.lo = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(node) else np.empty(0, np.int64)
        self.hi = np.append(self.lo[1:], len(node)) if len(node) else self.lo

    def near(self, blocks: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs i, j of the leaves of each of two nodes that differ in at most ``ERRORS`` of the bits and ``level`` of all, and in how many."""
        found, size = [(np.empty(0, np.int64),) * 3], 0
        left, right = [], []

        def told():
            i, j = np.concatenate(left), np.concatenate(right)
            d = np.bitwise_count(self.fp[i] ^ self.fp[j]).sum(axis=1, dtype=np.int64)
            found.append((i[d <= level], j[d <= level], d[d <= level]))
            left.clear()
            right.clear()

        for a, b, c, e in blocks.T.tolist():
            for at in range(a, b, ROWS):
                to = min(at + ROWS, b)
                hit = np.bitwise_count(self.low[at:to, None] ^ self.low[None, c:e]) <= ERRORS
                i, j = np.nonzero(hit)
                i, j = i + at, j + c
                if a == c:
                    i, j = i[i < j], j[i < j]
                left.append(i)
                right.append(j)
                size += len(i)
                if size > COMPARED:
                    told()
                    size = 0
        if left:
            told()
        return tuple(np.concatenate(x) for x in zip(*found))

    def joined(self, lo: np.ndarray, hi: np.ndarray, level: int, prune: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Near pairs among the leaves of each node ``lo`` to ``hi``: node pairs are taken down together.

        With ``prune`` pairs of nodes whose leaves hang together in the forest are left out.
        """
        stack = [(0, np.stack([lo, hi, lo, hi, np.zeros(len(lo), np.int64)]))]
        while stack:
            depth, pairs = stack.pop()
            if prune:
                root = self.forest.roots()
                changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
                a, b, c, e, _ = pairs
                pairs = pairs[:, ~((changes[b - 1] == changes[a]) & (changes[e - 1] == changes[c]) & (root[a] == root[c]))]
            a, b, c, e, err = pairs
            few = (b - a) * (e - c) <= OUTRIGHT if depth < BITS else np.ones(len(a), bool)
            if few.any():
                yield self.near(pairs[:4, few], level)
            a, b, c, e, err = pairs[:, ~few]
            if not len(a):
                continue
            bit = np.int64(1 << (BITS - 1 - depth))
            keep = ~np.int64((1 << (BITS - depth)) - 1)
            am = np.clip(np.searchsorted(self.node, (self.node[a] & keep) | bit), a, b)
            cm = np.clip(np.searchsorted(self.node, (self.node[c] & keep) | bit), c, e)
            other = a != c
            down = np.concatenate([np.stack([a, am, c, cm, err]), np.stack([am, b, cm, e, err]), np.stack([a, am, cm, e, err + 1]), np.stack([am, b, c, cm, err + 1])[:, other]], axis=1)
            down = down[:, (down[1] > down[0]) & (down[3] > down[2]) & (down[4] <= ERRORS)]
            down = down[:, ~((down[0] == down[2]) & (down[1] - down[0] == 1))]  # a leaf with itself
            down = down[:, np.argsort(-down[4], kind="stable")]  # what agrees so far comes off the stack first
            stack += [(depth + 1, down[:, k : k + FRONTIER]) for k in range(0, down.shape[1], FRONTIER)]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of a spanning forest of the nearest pairs: places i and j and their differing bits."""
        size = self.hi - self.lo
        out = [(np.empty(0, np.int64),) * 3]

        def take(i, j, d):
            if len(i):
                took = forest_edges(self.forest, i, j, d)
                out.append((i[took], j[took], d[took]))

        # few rows to a prefix: all near pairs of several prefixes at once, then their forest
        small = np.flatnonzero((size > 1) & (size <= SMALL))
        part = np.cumsum(size[small] ** 2) // PAIRS
        for mine in np.split(small, np.flatnonzero(np.diff(part)) + 1):
            take(*(np.concatenate(x) for x in zip(*self.joined(self.lo[mine], self.hi[mine], LEVELS[-1], False), strict=True))) if len(mine) else None
        # many rows: the nearest first, so that what hangs together is not compared again
        for lo, hi in zip(self.lo[size > SMALL].tolist(), self.hi[size > SMALL].tolist()):
            own = Trie(self.node[lo:hi], self.fp[lo:hi])
            for level in LEVELS:
                for i, j, d in own.joined(own.lo, own.hi, level, True):
                    took = forest_edges(own.forest, i, j, d)
                    out.append((i[took] + lo, j[took] + lo, d[took]))
        return tuple(np.concatenate(x) for x in zip(*out))


def trie_edges(node: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a spanning forest of the nearest pairs: places i and j and their differing bits.

    ``node``: sorted, a number for the prefix and then ``BITS`` bits. Pairs share the
    prefix, differ in at most ``ERRORS`` of the bits and in at most the last of
    ``LEVELS`` of all.
    """
    return Trie(node, fp).edges()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("deal", "prefix", "cell", "bits", "text_key", *PARTS)
    got = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    if not got:
        return
    deal, prefix, cell, bits, text_key, *fp = (np.concatenate(x) for x in zip(*got))
    del got
    order = np.lexsort((bits, cell, prefix, deal))
    new = np.zeros(len(order), bool)
    for column in (deal, prefix, cell):
        new[1:] |= np.diff(column[order]) != 0
    node = np.cumsum(new) << BITS | bits[order]
    i, j, d = trie_edges(node, np.stack([x[order].view(np.uint64) for x in fp], axis=1))
    text_key = text_key[order]
    tidy()
    if len(i):
        a, b = text_key[i], text_key[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], names=["a", "b", "d"])


def candidates(classes: DataFrame) -> DataFrame:
    """Links ``a, b, d`` among the distinct texts ``classes`` (``text_key`` and the parts of the fingerprint)."""
    n = classes.count()
    prefix = int(np.ceil(np.log2(max(1, n / SHARING))))
    deals = int(np.ceil(DEALS * AGREE ** (8 - prefix)))
    dealt = classes.select("text_key", *PARTS).mapInArrow(_dealt(prefix, deals), DEALT).withColumn("cell", F.lit(0).cast("long"))
    if n > MOST_ROWS:  # else no prefix can have more
        crowded = cut(dealt.groupBy("deal", "prefix").count().where(F.col("count") > MOST_ROWS).select("deal", "prefix", F.ceil(F.col("count") / (MOST_ROWS / 2)).alias("blocks")), "similar-crowded")
        mine = F.pmod(F.xxhash64("text_key"), F.col("blocks"))
        met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine))
        dealt = dealt.drop("cell").join(crowded, ["deal", "prefix"], "left").withColumn("cell", F.explode(F.coalesce(met, F.array(F.lit(0).cast("long"))))).drop("blocks")
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * deals // (4 * MOST_ROWS)))
    return dealt.repartition(tasks, "deal", "prefix", "cell").mapInArrow(_joined, "a long, b long, d int")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            key, bounds, _ = shingles([t or "" for t in part.column(1).to_pylist()])
            raw = key.tobytes()
            held = pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), held], names=["component", "text_key", "held"])


def held_sets(near: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``component, text_key, held``: the shingle sets of the text keys in ``near`` (``node, component``).

    ``classes`` names one row (``key``) of each text key, ``texts`` has the rows' texts by ``key``.
    """
    wanted = classes.select("text_key", "key").join(near.select(F.col("node").alias("text_key"), "component"), "text_key").hint("merge")
    # one row a key: copies of a row have one key
    one = texts.join(wanted, "key").groupBy("text_key").agg(F.first("text").alias("text"), F.first("component").alias("component"))
    return one.select("text_key", "text", "component").mapInArrow(_sets, "component long, text_key long, held binary")


def groups(docs: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``key, doc_id, text_key`` of each row of ``docs``, and ``text_key, label`` of each distinct text: its group."""
    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = cut(rows.select("key", "doc_id", "text").mapInArrow(_prints, PRINTS), "similar-prints")
    ids = prints.select("key", "doc_id", "text_key")
    classes = cut(prints.groupBy("text_key").agg(F.min("key").alias("key"), *(F.min(c).alias(c) for c in PARTS)), "similar-classes")
    near = connected(candidates(classes))
    members = cut(held_sets(near, rows.select("key", "text"), classes), "similar-sets")
    label = resolved(members, threshold).select(F.col("node").alias("text_key"), F.col("component").alias("label"))
    return ids, label


def one_of_each(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The row with the smallest ``doc_id`` (null: largest), then hash of its text, of each group, all columns kept.

    Of rows equal in ``doc_id`` and text the one with the smallest hash of all columns stays.
    """
    with scratch(docs.sparkSession):
        ids, label = groups(docs, threshold)
        rows = ids.join(label, "text_key", "left").withColumn("label", F.coalesce("label", "text_key"))
        best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("best")).select(F.col("best.key").alias("key"))
        kept = cut(ids.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(best.hint("merge"), "key"), "similar-kept", keep=True)
    keyed = docs.withColumn("__key", row_key())
    # both grow with the documents: never broadcast
    single = keyed.join(kept.where("n = 1").select(F.col("key").alias("__key")).hint("merge"), "__key", "left_semi").select(*docs.columns)
    several = keyed.join(kept.where("n > 1").select(F.col("key").alias("__key")), "__key", "left_semi")
    first = several.groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return single.unionByName(first.select("row.*"))
