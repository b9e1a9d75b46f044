"""Toxic spans of a text by a linear-chain conditional random field over its words.

Tokens are runs of letters, lower-cased; a chain is a sentence or line. Labelled
tokens come from document labels: the shortest list of words and word beginnings,
each found in toxic documents and hardly elsewhere, that explains the toxic
documents (chosen greedily) marks the tokens. The field then learns, from words,
beginnings, ends and neighbours, to tag such tokens in any text. With two tags the
messages of the forward-backward pass are one log ratio each, computed for all
chains at once, a place after another.

A document's score is a logistic function of its largest and its summed marginals,
fitted on the labelled documents; the offending offsets are the runs of tokens
whose marginal is at least one half.

A long chain teaches in pieces of ``PIECE`` tokens, all of them; its marginals are exact
at any length, as the messages between its pieces are found first.

Defined cases: null text is empty; a text without letters has no spans and the
score of an empty text; labels that are null or belong to no document teach
nothing; of several texts with one labelled ``doc_id`` the least teaches; where one
class has no rows every score is that of the other; where no word tells toxic
documents from others, or none has a word, every score is the toxic share of the
labels; rows that repeat are each answered; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textnum as tn
from .shared import cut, scratch, sent, tidy
from .token_store import slices

#: Labelled documents that the model is fitted on, by order of a hash of doc_id, half of each class.
FIT_DOCS = 6000
#: Words and beginnings that may explain toxic documents: at least so many of them, and so large a share of all documents that hold one.
LEAST_DOCS, LEAST_SHARE = 3, 0.995
#: The share of the toxic documents that a listed word must explain first, or further where they have less than so many explanations.
LEAST_GAIN, FURTHER_GAIN, EXPLANATIONS = 0.002, 0.02, 3
#: Pieces of chains that the field is fitted on: half of them with a marked token, half without, each by order of a hash.
FIT_CHAINS = 30_000
#: Tokens of these pieces at most, half of them in either kind: what the driver holds while the field is fitted, about 250 bytes a token.
FIT_TOKENS = 1_600_000
#: Tokens of a piece that teaches, and of one whose messages are passed on in one go.
PIECE, RUN = 200, 512
SPACE = 1 << 17
ROUNDS, RATE, PENALTY = 120, 0.5, 1e-4
STOPS = np.array([10, ord("."), ord("!"), ord("?")])
BEGINNINGS = (4, 5, 6)


@dataclass
class Tokens:
    bounds: np.ndarray  # first token of each text, and the end
    starts: np.ndarray  # code points within the batch
    ends: np.ndarray
    text_starts: np.ndarray
    word: np.ndarray  # hash of each token
    parts: np.ndarray  # hashes of beginnings and of the end, a column each; 0: too short
    chain: np.ndarray  # first token of each chain


def tokens_of(texts: list[str]) -> Tokens:
    # lower-casing by code point keeps the offsets
    cp, text_starts = tn.points(texts)
    low = _lower()[cp]
    starts, ends = tn.runs(tn.letters()[cp])
    values = tn.mixed(low)
    length = ends - starts
    columns = []
    for k in (*BEGINNINGS, -3):
        fits = length > abs(k)
        a, b = (starts[fits], starts[fits] + k) if k > 0 else (ends[fits] + k, ends[fits])
        h = np.zeros(len(starts), np.uint64)
        h[fits] = tn.mixed(tn.hashes(values, a, b) + np.uint64(k % 64))
        columns.append(h)
    stop = np.cumsum(np.isin(cp, STOPS))
    sentence = stop[starts]
    chain = np.flatnonzero(np.diff(sentence, prepend=-1))
    return Tokens(tn.per_text(starts, text_starts), starts, ends, text_starts, tn.hashes(values, starts, ends), np.stack(columns, axis=1) if len(starts) else np.zeros((0, len(columns)), np.uint64), chain)


_lowered: list[np.ndarray] = []


def _lower() -> np.ndarray:
    if not _lowered:
        out = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x20000):
            c = chr(i).lower()
            if len(c) == 1:
                out[i] = ord(c)
        _lowered.append(out)
    return _lowered[0]


def features(t: Tokens) -> np.ndarray:
    """Slots of each token's features: word, beginnings, end, word before and after; ``SPACE``: none."""
    n = len(t.word)
    slot = lambda h, salt: ((tn.mixed(h + np.uint64(salt)) >> np.uint64(47)) % np.uint64(SPACE)).astype(np.int32)
    out = np.full((n, 3 + t.parts.shape[1]), SPACE, np.int32)
    if not n:
        return out
    out[:, 0] = slot(t.word, 1)
    for k in range(t.parts.shape[1]):
        out[:, 1 + k] = np.where(t.parts[:, k] > 0, slot(t.parts[:, k], 2), SPACE)
    first = np.zeros(n, bool)
    first[t.chain] = True
    out[1:, -2] = np.where(first[1:], SPACE, slot(t.word[:-1], 3))
    out[:-1, -1] = np.where(first[1:], SPACE, slot(t.word[1:], 4))
    return out


def pieces(chain: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of at most ``most`` tokens of all chains, and which piece continues a chain."""
    length = np.diff(np.append(chain, n))
    count = -(-length // most)
    place = tn.within(count)
    start = np.repeat(chain, count) + place * most
    return start, np.minimum(np.repeat(chain + length, count) - start, most), place > 0


def _between(s: np.ndarray, start: np.ndarray, length: np.ndarray, later: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds that come into each piece of a long chain: of the token before it, and those after it for its last token.

    A piece acts on what comes in as one 2 x 2 matrix, a product over its tokens.
    """
    before, after = np.zeros(len(start)), np.zeros(len(start))
    long = np.flatnonzero(later | np.append(later[1:], False))
    at, n, first = start[long], length[long], ~later[long]
    step = np.exp(move)
    product = np.repeat(np.eye(2)[None], len(long), axis=0)
    for t in range(int(n.max(initial=0))):
        on = np.flatnonzero((t < n) & ~(first & (t == 0)))
        own = np.exp(np.clip(s[at[on] + t], -300, 300))
        p = product[on] @ step
        p[:, :, 1] *= own[:, None]
        product[on] = p / p.sum(axis=(1, 2), keepdims=True)
    v = np.ones(2)
    for k in range(len(long)):
        if first[k]:
            own = float(np.exp(np.clip(s[at[k]], -300, 300)))
            v = np.array([1.0, own]) / (1 + own)
        else:
            before[long[k]] = np.log(max(v[1], 1e-300)) - np.log(max(v[0], 1e-300))
        v = v @ product[k]
        v /= v.sum()
    v = np.ones(2)
    for k in range(len(long) - 1, -1, -1):
        if k + 1 == len(long) or first[k + 1]:
            v = np.ones(2)
        after[long[k]] = np.log(max(v[1], 1e-300)) - np.log(max(v[0], 1e-300))
        v = product[k] @ v
        v /= v.sum()
    return before, after


def marginals(s: np.ndarray, chain: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of tag 1 against 0: all that precedes a token and itself, all that follows it, both.

    ``s``: the tokens' own log odds; ``chain``: first token of each; ``move[a, b]``: score of tag b after a.
    """

    def onward(r):
        return np.logaddexp(move[0, 1], r + move[1, 1]) - np.logaddexp(move[0, 0], r + move[1, 0])

    forward, backward = s.copy(), np.zeros(len(s))
    start, length, later = pieces(chain, len(s), RUN)
    if later.any():
        before, after = _between(s, start, length, later, move)
        forward[start[later]] += onward(before[later])
        backward[start + length - 1] = after
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = len(start)
    counts = []
    for t in range(1, int(length[0]) if len(length) else 0):
        active = int(np.searchsorted(-length[:active], -t, side="left"))
        counts.append(active)
        at = start[:active] + t
        forward[at] += onward(forward[at - 1])
    for t in range(len(counts), 0, -1):
        at = start[: counts[t - 1]] + t
        r = s[at] + backward[at]
        backward[at - 1] = np.logaddexp(move[1, 0], move[1, 1] + r) - np.logaddexp(move[0, 0], move[0, 1] + r)
    return forward, backward, forward + backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Field:
    weight: np.ndarray  # of each feature slot, the last is 0
    bias: float
    move: np.ndarray
    scale: np.ndarray  # of the document score: intercept, largest, summed

    def own(self, slots: np.ndarray) -> np.ndarray:
        return self.weight[slots].sum(axis=1) + self.bias


def train(slots: np.ndarray, y: np.ndarray, chain: np.ndarray) -> Field:
    """Adagrad on the penalised conditional log-likelihood of whole chains."""
    field = Field(np.zeros(SPACE + 1), -2.0, np.zeros((2, 2)), np.zeros(3))
    first = np.zeros(len(y), bool)
    first[chain] = True
    pair = np.flatnonzero(~first)  # tokens with one before them
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[pair - 1], y[pair]), 1)
    squares, bias_square, move_square = np.full(SPACE + 1, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    n = max(1, len(chain))
    for _ in range(ROUNDS):
        s = field.own(slots)
        forward, backward, both = marginals(s, chain, field.move)
        err = sigmoid(both) - y
        grad = PENALTY * field.weight
        for column in slots.T:
            grad += np.bincount(column, err, SPACE + 1) / n
        a, b = forward[pair - 1], s[pair] + backward[pair]
        joint = np.stack([np.full(len(pair), field.move[0, 0]), field.move[0, 1] + b, field.move[1, 0] + a, field.move[1, 1] + a + b])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        move_grad = (joint.sum(axis=1).reshape(2, 2) - seen) / n + PENALTY * field.move
        squares += grad**2
        field.weight -= RATE * grad / np.sqrt(squares)
        field.weight[SPACE] = 0
        bias_square += (err.sum() / n) ** 2
        field.bias -= RATE * err.sum() / n / np.sqrt(bias_square)
        move_square += move_grad**2
        field.move = field.move - RATE * move_grad / np.sqrt(move_square)
    return field


def summaries(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text: 1, the log odds of its largest marginal, the logarithm of 1 and the sum of those over 0.1."""
    n = len(bounds) - 1
    top = np.zeros(n)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        top[full] = np.maximum.reduceat(p, bounds[full])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(tn.sums(np.where(p > 0.1, p, 0.0), bounds))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) / len(y) + penalty * w)
    return w


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents of the task each word and beginning occurs."""
    for batch in batches:
        for part in slices(batch, "text", 4_000_000):
            t = tokens_of([x or "" for x in part.column(0).to_pylist()])
            toxic = np.array(part.column(1).to_pylist(), bool)
            doc = np.repeat(np.arange(part.num_rows), np.diff(t.bounds))
            for column in (t.word, *t.parts[:, : len(BEGINNINGS)].T):
                used = column > 0
                key, d = column[used], doc[used]
                order = np.lexsort((d, key))
                key, d = key[order], d[order]
                once = np.concatenate([[True], (key[1:] != key[:-1]) | (d[1:] != d[:-1])]) if len(key) else np.zeros(0, bool)
                key, d = key[once], d[once]
                kinds, first = np.unique(key, return_index=True)
                if len(kinds):
                    bad = np.add.reduceat(toxic[d].astype(np.int64), first)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(bad), pa.array(np.diff(np.append(first, len(key))).astype(np.int64) - bad)], names=["key", "bad", "good"])


def _holds(keys):
    """The candidates that each toxic document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = keys.value
        for batch in batches:
            for part in slices(batch, "text"):
                t = tokens_of([x or "" for x in part.column(0).to_pylist()])
                found = []
                for a, b in zip(t.bounds[:-1], t.bounds[1:]):
                    at, known = tn.lookup(table, np.concatenate([t.word[a:b], *t.parts[a:b, : len(BEGINNINGS)].T]))
                    found.append(np.unique(at[known]).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["held"])

    return run


def explaining(keys: np.ndarray, held: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """Of ``keys`` those that explain most documents not yet explained, one after another; ties by ``weight``, then key.

    Once no key explains enough of the rest, those follow that give the most
    documents a further explanation, up to ``EXPLANATIONS`` each.
    """
    times = np.zeros(len(held), np.int64)
    owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
    item = np.concatenate(held) if held else np.empty(0, np.int64)
    chosen = []
    for wanted, least in ((1, LEAST_GAIN), *((k, FURTHER_GAIN) for k in range(2, EXPLANATIONS + 1))):
        while len(item):
            gain = np.bincount(item[times[owner] < wanted], minlength=len(keys))
            if gain.max() < max(2 if wanted == 1 else LEAST_DOCS, least * len(held)):
                break
            best = int(np.lexsort((keys, -weight, -gain))[0])
            chosen.append(keys[best])
            times[owner[item == best]] += 1
            item, owner = item[item != best], owner[item != best]
    return np.sort(np.array(chosen, np.uint64))


def marked(t: Tokens, listed: np.ndarray) -> np.ndarray:
    """Whether each token, or a beginning of it, is listed."""
    out = tn.lookup(listed, t.word)[1]
    for k in range(len(BEGINNINGS)):
        out |= tn.lookup(listed, t.parts[:, k])[1]
    return out


def _chains(listed: np.ndarray, share: float):
    """Pieces of chains with a marked token, and a share of the others by a hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t = tokens_of([x or "" for x in part.column(0).to_pylist()])
                toxic = np.repeat(np.array(part.column(1).to_pylist(), bool), np.diff(t.bounds))
                y = marked(t, listed) & toxic
                if not len(y):
                    continue
                start, length, _ = pieces(t.chain, len(y), PIECE)
                some = np.add.reduceat(y.astype(np.int64), start) > 0
                draw = (tn.mixed(np.add.reduceat(t.word, start)) >> np.uint64(11)) / float(1 << 53)
                keep = np.flatnonzero(some | (draw < share))
                if not len(keep):
                    continue
                slots = features(t)
                spans = list(zip(start[keep].tolist(), (start + length)[keep].tolist()))
                yield pa.RecordBatch.from_pydict({"some": some[keep], "order": draw[keep], "slots": [slots[a:b].astype("<i4").tobytes() for a, b in spans], "y": [y[a:b].tobytes() for a, b in spans]})

    return run


def _measured(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = field.value
        for batch in batches:
            for part in slices(batch, "text"):
                t = tokens_of([x or "" for x in part.column(0).to_pylist()])
                p = sigmoid(marginals(f.own(features(t)), t.chain, f.move)[2])
                x = summaries(p, t.bounds)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), part.column(1)], names=["largest", "summed", "y"])

    return run


def _first_tokens(chains: DataFrame) -> DataFrame:
    """The first pieces in order, ``FIT_CHAINS / 2`` and ``FIT_TOKENS / 2`` tokens at most."""
    order = W.orderBy("order", "slots")  # over FIT_CHAINS / 2 rows
    first = chains.orderBy("order", "slots").limit(FIT_CHAINS // 2).withColumn("upto", F.sum(F.length("y")).over(order))
    return first.where(F.col("upto") <= FIT_TOKENS // 2).drop("upto")


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, fit_docs: int = FIT_DOCS) -> Field | float:
    """A field from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) where ``teaches`` holds of doc_id.

    About ``fit_docs`` documents at most are read, half of each class. Without both
    classes the share of class 1 is returned (0.0 without any label).
    """
    spark = docs.sparkSession
    known = labels.where(teaches & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    found = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        return float(next(iter(found), 0.0))
    share = F.when(F.col("y") == 1, min(1.0, fit_docs / 2 / found[1])).otherwise(min(1.0, fit_docs / 2 / found[0]))
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    chosen = cut(known.where(uniform <= share), "toxicity-chosen")
    # `chosen` has about fit_docs rows of 12 bytes; of the texts that a doc_id stands for one teaches
    one_each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = cut(one_each.groupBy("text").agg(F.max("y").alias("y")), "toxicity-sample")
    spread = sample.select("text", "y").mapInArrow(_spread, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # words of about fit_docs texts; of these few are candidates
    top = spread.where((F.col("bad") >= LEAST_DOCS) & (F.col("bad") >= LEAST_SHARE * (F.col("bad") + F.col("good")))).select("key", "bad").collect()
    keys, weight = np.array([r["key"] for r in top], np.int64).view(np.uint64), np.array([r["bad"] for r in top], np.int64)
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    prior = found[1] / (found[0] + found[1])
    with sent(spark, keys) as known_keys:
        held = [np.frombuffer(r["held"], "<i4") for r in sample.where("y = 1").select("text").mapInArrow(_holds(known_keys), "held binary").collect()]
    listed = explaining(keys, held, weight)
    if not len(listed):
        return prior
    rate = min(1.0, FIT_CHAINS / 2 / max(1, sample.count() * 20))
    chains = cut(sample.select("text", "y").mapInArrow(_chains(listed, rate), "some boolean, order double, slots binary, y binary"), "toxicity-chains")
    rows = [r for some in (True, False) for r in _first_tokens(chains.where(F.col("some") == some)).collect()]
    if not rows:
        return prior
    slots = [np.frombuffer(r["slots"], "<i4").reshape(-1, 3 + len(BEGINNINGS) + 1) for r in rows]
    y = np.concatenate([np.frombuffer(r["y"], bool) for r in rows]).astype(np.int64)
    del rows
    begins = np.cumsum([0, *map(len, slots)])[:-1]
    slots = np.concatenate(slots)  # frees the pieces
    field = train(slots, y, begins)
    with sent(spark, field) as known_field:
        seen = sample.select("text", "y").mapInArrow(_measured(known_field), "largest double, summed double, y int").collect()
    x = np.array([(1.0, r["largest"], r["summed"]) for r in seen])
    truth = np.array([r["y"] for r in seen], np.float64)
    total = found[0] + found[1]
    field.scale = logistic(x, truth, np.where(truth == 1, found[1] / total / max(truth.mean(), 1e-9), found[0] / total / max(1 - truth.mean(), 1e-9)))
    tidy()
    return field


SCORED = "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>"


def _tag(model):
    types = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                if isinstance(f, float):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, f)), pa.array([[]] * n, types)], names=["doc_id", "score", "spans"])
                    continue
                t = tokens_of([x or "" for x in part.column(1).to_pylist()])
                p = sigmoid(marginals(f.own(features(t)), t.chain, f.move)[2])
                spans: list[list] = [[] for _ in range(n)]
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    first = np.zeros(len(p), bool)
                    first[t.chain] = True
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | first[hit[1:]]]))
                    last = np.append(new[1:], len(hit)) - 1
                    owner = np.searchsorted(t.bounds, hit[new], side="right") - 1
                    for a, b, k in zip(hit[new].tolist(), hit[last].tolist(), owner.tolist()):
                        base = int(t.text_starts[k])
                        spans[k].append({"start": int(t.starts[a]) - base, "end": int(t.ends[b]) - base, "marginal": float(p[a : b + 1].max())})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(summaries(p, t.bounds) @ f.scale)), pa.array(spans, types)], names=["doc_id", "score", "spans"])

    return run


def tag(docs: DataFrame, model: Field | float) -> DataFrame:
    """``doc_id, score, spans`` of every row of ``docs``; offsets are code points, ends exclusive."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tag(held), SCORED)


def fold(n: int) -> Column:
    """crc32 of doc_id as text modulo ``n``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans``: learnt from folds 1 to 4 of five."""
    with scratch(docs.sparkSession):
        model = fit(docs, labels, fold(5) != 0)
    tagged = tag(docs, model)
    return tagged.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
