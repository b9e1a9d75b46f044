"""Quality of a text: random-indexing word vectors pooled per document, and a small network.

A word is what white space separates. Its index vector is sparse and random, by a
hash of the word; its context vector is the sum of the index vectors of the words
that stand near it in the fitted texts. Besides itself each word stands for its
shape (runs of upper case, letters, digits and signs), which has an index vector
too, so that words never seen still say what they look like. A document pools the
means of both, with its length and how much of it repeats. A network with one
hidden layer scores the pooled vector, and a temperature fitted on rows that the
network has not seen makes its output a probability. Every labelled text teaches:
context vectors, network (L-BFGS, a pass over the pooled vectors a step) and
temperature come from sums over tasks, and no row reaches the driver.

Defined cases: null text is empty; an empty text has a pooled vector of zeros and
gets the network's score for that; words whose hashes fall into one of ``BUCKETS``
share a context vector; labels that are null or belong to no document
teach nothing; of several texts with one labelled ``doc_id`` the least teaches; where
one class has no rows every score is that of the other; rows that repeat are each
answered; a score of exactly 0.7 is predicted 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .decontaminate import segment_sums
from .shared import cut, scratch, sent, tidy
from .token_store import slices

BUCKETS, SHAPES, DIMENSIONS, NONZERO = 1 << 15, 1 << 12, 48, 6
NEAR = 2
LEAST_COUNT = 3
HIDDEN, SEED = 32, 7
#: Weight of the squares of the network's slopes, steps at most, steps remembered, and the least part of the loss that a step must gain.
DECAY, STEPS, REMEMBERED, GAIN = 1e-4, 24, 12, 1e-2
EXTRAS = 5
PIECE = 1 << 16


def index_vectors(n: int, seed: int) -> np.ndarray:
    """A sparse random vector of signs for each of ``n`` buckets, the same everywhere."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIMENSIONS), np.float32)
    at = np.argsort(rng.random((n, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (n, NONZERO)), axis=1)
    return out


_index: dict[int, np.ndarray] = {}


def _vectors(n: int, seed: int) -> np.ndarray:
    if seed not in _index:
        _index[seed] = index_vectors(n, seed)
    return _index[seed]


@dataclass
class Words:
    bounds: np.ndarray  # first word of each text, and the end
    hash: np.ndarray
    shape: np.ndarray
    again: np.ndarray  # the word before is the same
    line_again: np.ndarray  # its line stands in the text before
    letters: np.ndarray  # code points a word


def words_of(texts: list[str]) -> Words:
    cp, text_starts = tn.points(texts)
    kind = tn.kinds()[cp]
    inside = kind != 4
    starts, ends = tn.runs(inside)
    bounds = tn.per_text(starts, text_starts)
    hashed = tn.hashes(tn.mixed(cp), starts, ends)
    # the shape: the first of each run of one kind within a word
    new = inside & (np.diff(kind, prepend=np.uint32(0)) != 0)
    new[starts] = True
    places = np.cumsum(new)
    shape = tn.hashes(tn.mixed(kind[new]), places[starts] - 1, places[ends - 1])
    again = np.zeros(len(starts), bool)
    if len(starts):
        again[1:] = hashed[1:] == hashed[:-1]
        again[bounds[:-1][bounds[:-1] < len(starts)]] = False
    # lines by the hash of their words
    line = np.searchsorted(np.flatnonzero(cp == 10), starts)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    line_again = np.zeros(len(starts), bool)
    if len(first):
        sizes = np.diff(np.append(first, len(starts)))
        key = tn.hashes(hashed, first, first + sizes)
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))[first]
        _, once = np.unique(tn.mixed(key + text.astype(np.uint64)), return_index=True)
        repeated = np.ones(len(first), bool)
        repeated[once] = False
        line_again = np.repeat(repeated & (sizes > 2), sizes)
    return Words(bounds, hashed, shape, again, line_again, ends - starts)


def buckets(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % n


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors by bucket, over all texts of the task."""
    index = np.append(_vectors(BUCKETS, 1), np.zeros((1, DIMENSIONS)), axis=0).astype(np.int8)
    total, count = np.zeros((BUCKETS, DIMENSIONS), np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            w = words_of([x or "" for x in part.column(0).to_pylist()])
            b = buckets(w.hash, BUCKETS)
            # NEAR places without a word stand between texts, so that neighbours are those of one text
            text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
            place = np.arange(len(b)) + NEAR * (text + 1)
            spaced = np.full(len(b) + NEAR * len(w.bounds), BUCKETS)
            spaced[place] = b
            for at in range(NEAR, len(spaced) - NEAR, PIECE):
                end = min(at + PIECE, len(spaced) - NEAR)
                rows = index[spaced[at - NEAR : end + NEAR]]
                near = sum(rows[NEAR + k : len(rows) - NEAR + k] for k in range(-NEAR, NEAR + 1) if k)
                mine = spaced[at:end].astype(np.uint16)
                order = np.argsort(mine, kind="stable")
                order = order[: np.count_nonzero(mine < BUCKETS)]
                if len(order):
                    first = np.flatnonzero(np.diff(mine[order].astype(np.int64), prepend=-1))
                    total[mine[order][first]] += segment_sums(near, order, first)
            count += np.bincount(b, minlength=BUCKETS)
    there = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(count[there]), *map(pa.array, total[there].T)], names=["bucket", "n", *_columns()])


def _columns() -> list[str]:
    return [f"c{k}" for k in range(DIMENSIONS)]


def context_vectors(texts: DataFrame) -> np.ndarray:
    """Unit context vectors, a row a bucket, of all ``texts`` (text); sums are of whole numbers, so their order is free."""
    sums = texts.select("text").mapInArrow(_contexts, ", ".join(f"{c} long" for c in ["bucket", "n", *_columns()])).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["n", *_columns()]])
    found = sums.where(F.col("n") >= LEAST_COUNT).toArrow()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    total = np.column_stack([found.column(c).to_numpy() for c in _columns()]).astype(np.float64)
    out[found.column("bucket").to_numpy()] = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    return out


def pooled(texts: list[str], contexts: np.ndarray) -> np.ndarray:
    """A row a text: mean context vector, mean shape vector, extras."""
    w = words_of(texts)
    n = np.diff(w.bounds)
    out = np.zeros((len(texts), 2 * DIMENSIONS + EXTRAS))
    text = np.repeat(np.arange(len(texts)), n)
    shape = _vectors(SHAPES, 2)
    b, s = buckets(w.hash, BUCKETS), buckets(w.shape, SHAPES)
    for at in range(0, len(b), PIECE):
        part = slice(at, at + PIECE)
        first = np.flatnonzero(np.diff(text[part], prepend=-1))
        mine = text[part][first]
        out[mine, :DIMENSIONS] += np.add.reduceat(contexts[b[part]], first, axis=0)
        out[mine, DIMENSIONS : 2 * DIMENSIONS] += np.add.reduceat(shape[s[part]], first, axis=0)
    some = np.maximum(n, 1)
    out[:, : 2 * DIMENSIONS] /= some[:, None]
    extras = [np.bincount(text, x, len(texts)) / some for x in (w.again, w.line_again, w.letters)]
    out[:, 2 * DIMENSIONS :] = np.stack([extras[0], extras[1], np.log1p(extras[2]), np.log1p(n) / 5, n == 0], axis=1)
    return out


@dataclass
class Network:
    contexts: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _summed(rows: DataFrame, of) -> np.ndarray:
    """The sum over all ``rows`` (x, y) of what ``of`` makes of some of them; an array a task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.frombuffer(b"".join(part.column(0).to_pylist()), "<f4").reshape(part.num_rows, -1).astype(np.float64)
                total = total + of(x, part.column(1).to_numpy(zero_copy_only=False))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_pydict({"sums": [total.astype("<f8").tobytes()]})

    return sum(np.frombuffer(r["sums"], "<f8") for r in rows.select("x", "y").mapInArrow(run, "sums binary").collect())


def minimised(f, p: np.ndarray) -> np.ndarray:
    """Where L-BFGS from ``p`` leads; ``f`` gives loss and slopes."""
    loss, g = f(p)
    known: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        d, shares = -g, []
        for s, v in reversed(known):
            shares.append((s @ d) / (s @ v))
            d = d - shares[-1] * v
        if known:
            s, v = known[-1]
            d = d * ((s @ v) / (v @ v))
        for (s, v), share in zip(known, reversed(shares)):
            d = d + (share - (v @ d) / (s @ v)) * s
        step = 1.0 if known else min(1.0, 1 / max(float(np.linalg.norm(g)), 1e-9))
        for _ in range(8):
            new, slopes = f(p + step * d)
            if new <= loss + 1e-4 * step * (g @ d):
                break
            step *= 0.3
        else:
            return p
        s, v = step * d, slopes - g
        if s @ v > 1e-10 * (v @ v):
            known = [*known, (s, v)][-REMEMBERED:]
        gained = loss - new
        p, loss, g = p + s, new, slopes
        if gained < GAIN * loss:
            break
    return p


def train(rows: DataFrame, late: DataFrame | None, contexts: np.ndarray) -> Network:
    """The network of least log loss on all ``rows`` (x, y); ``late``, not among them, set the temperature."""
    width = 2 * DIMENSIONS + EXTRAS
    first = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0)]))
    n, mean = first[0], first[1:] / first[0]
    spread = np.sqrt(_summed(rows, lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n) + 1e-3
    ends = np.cumsum([width * HIDDEN, HIDDEN, HIDDEN])

    def parts(p):
        w1, b1, w2, b2 = np.split(p, ends)
        return w1.reshape(width, HIDDEN), b1, w2, b2[0]

    def loss(p):
        w1, b1, w2, b2 = parts(p)

        def slopes(x, y):
            z = (x - mean) / spread
            h = np.tanh(z @ w1 + b1)
            logits = h @ w2 + b2
            err = 1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y
            back = err[:, None] * w2 * (1 - h * h)
            return np.concatenate([[np.logaddexp(0, (1 - 2 * y) * logits).sum()], (z.T @ back).ravel(), back.sum(axis=0), h.T @ err, [err.sum()]])

        sums = _summed(rows, slopes) / n
        decayed = DECAY * np.concatenate([w1.ravel(), 0 * b1, w2, [0]])
        return sums[0] + decayed @ p / 2, sums[1:] + decayed

    rng = np.random.default_rng(SEED)
    start = np.concatenate([rng.normal(0, width**-0.5, width * HIDDEN), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), [0]])
    net = Network(contexts, mean, spread, *parts(minimised(loss, start)), 1.0)
    if late is not None:
        grid = np.exp(np.linspace(np.log(0.25), np.log(16), 200))
        plain = Network(contexts[:0], *[getattr(net, k) for k in ("mean", "spread", "w1", "b1", "w2", "b2", "temperature")])
        lost = _summed(late, lambda x, y: np.logaddexp(0, ((1 - 2 * y) * plain.logits(x))[:, None] / grid).sum(axis=0))
        net.temperature = float(grid[int(np.argmin(lost))])
    return net


def _pool(contexts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = pooled([t or "" for t in part.column(0).to_pylist()], contexts.value)
                yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()), part.column(1), part.column(2)], names=["x", "y", "late"])

    return run


def fit(docs: DataFrame, labels: DataFrame, teaches: Column) -> Network | float:
    """A network from all of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) where ``teaches`` holds of doc_id.

    Every fifth document by a hash of doc_id is kept back for the temperature. Without
    both classes the share of class 1 is returned (0.5 without any label).
    """
    spark = docs.sparkSession
    known = labels.where(teaches & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    found = [r["y"] for r in known.select("y").distinct().collect()]
    if len(found) < 2:
        return float(next(iter(found), 0.5))
    # labels grow with the documents, so they are not broadcast; of the texts that a doc_id stands for one teaches
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(teaches).join(known.hint("merge"), "doc_id")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4
    one_each = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").cast("double").alias("y")).sortWithinPartitions("doc_id")
    taught = cut(one_each.select("text", "y", late.alias("late")), "quality-taught")
    counts = {(r["late"], r["y"]) for r in taught.select("late", "y").distinct().collect()}
    classes = {y for _, y in counts}
    if len(classes) < 2:
        return float(next(iter(classes), 0.5))
    contexts = context_vectors(taught)
    with sent(spark, contexts) as held:
        rows = cut(taught.mapInArrow(_pool(held), "x binary, y double, late boolean"), "quality-pooled")
    if {(False, 0.0), (False, 1.0)} <= counts and len(counts) > 2:
        net = train(rows.where("not late"), rows.where("late"), contexts)
    else:  # too few rows to keep some back
        net = train(rows, None, contexts)
    tidy()
    return net


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                if isinstance(net, float):
                    s = np.full(part.num_rows, net)
                else:
                    s = net.scores(pooled([t or "" for t in part.column(1).to_pylist()], net.contexts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(held), "doc_id long, score double")


def fold(n: int) -> Column:
    """crc32 of doc_id as text modulo ``n``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


#: A document is kept if its score is at least this.
KEEP = 0.7


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learnt from folds 0, 1 and 3 of four."""
    with scratch(docs.sparkSession):
        model = fit(docs, labels, fold(4) != 2)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` predicts to be of quality 1, all columns kept, without a shuffle."""
    with scratch(docs.sparkSession):
        fitted = fit(docs, labels, fold(4) != 2)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for part in slices(batch, names[at]):
                if isinstance(net, float):
                    keep = np.full(part.num_rows, net >= KEEP)
                else:
                    keep = net.scores(pooled([t or "" for t in part.column(at).to_pylist()], net.contexts)) >= KEEP
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
