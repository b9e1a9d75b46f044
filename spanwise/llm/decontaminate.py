"""Benchmark passages in documents by latent semantic retrieval, then exact checks.

Words are runs of letters or digits, lower-cased. Documents are first rewritten as
the numbers of those of their words that the benchmark holds; all later passes read
these. Document frequencies over all passages give TF-IDF; a randomised SVD
(subspace iteration, sums over passages distributed) over the passages of the whole
benchmark and of every document gives the latent space. Each passage of each
document is compared with every passage of the benchmark by the cosine there, in
blocks. Candidates are then aligned: the longest common subsequence with the item
must cover most of it, or somewhat less of it together with its answer, the item's
rarest words.

The words around a short item would outweigh it in a passage. Items of fewer than
``PASSAGE`` words are therefore also looked up by their rarest words: a part of a
text that can be confirmed holds a few of them close together, and as many of all
the item's words as the rule wants. This search leaves out nothing that could be
confirmed.

Documents are coded once, and one latent space is fitted, whatever the number of items.
A benchmark of more than ``ITEMS_AT_ONCE`` items is searched in parts; ``PARTS_AT_ONCE``
parts share a pass over the codes, so that what a task holds of the benchmark's
passages stays bounded. How items are dealt into parts does not change a pair's answer. The driver holds the
benchmark's distinct words with their rows of the space, about 700 bytes a word.

Defined cases: null texts are empty; items without words match nothing; items of
fewer than ``SHORT`` words match whole runs only; rows that repeat an ``item_id`` are
one item for each distinct text; rows that repeat a ``doc_id`` are searched each and
answered once a pair; a null ``item_id`` is kept; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .shared import cut, row_key, scratch, sent, tidy
from .token_store import slices

PASSAGE, STRIDE = 32, 16
DIMENSIONS, OVERSAMPLED, ROUNDS, SEED = 64, 16, 3, 5
#: Weight of all documents together in the fit of the latent space, where all items have 1.
DOCUMENTS = 0.25
#: Bits of the whole numbers that the fit sums, at most: a sum of ``STRIDE`` blocks' sums fits into 32.
BITS = 22
ITEMS_AT_ONCE, PARTS_AT_ONCE = 500, 4
#: Cosine from which passages are candidates, and the share of the benchmark passage's weight that their common words must hold.
CANDIDATE, IN_COMMON = 0.7, 0.4
#: Share of an item that the common subsequence covers: alone, or with this share of the answer's words.
COVERED, PARAPHRASED, ANSWERED, ANSWER_WORDS = 0.8, 0.6, 2 / 3, 3
SHORT = 8
#: Rare words of a short item that are wanted together before its other words are counted, and places counted at once.
ANCHORS, COUNTED = 3, 4096
NONE = 0xFFFFFFFF
#: Words whose vectors are gathered at once.
GATHERED = 1 << 13
#: The same in the fit.
FITTED = 1 << 14


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray  # places in the vocabulary
    answer: np.ndarray


@dataclass
class Index:
    vocabulary: np.ndarray  # sorted hashes
    items: list[Item]
    idf: np.ndarray  # the last is that of other words
    basis: np.ndarray  # vocabulary x dimensions, times idf
    passages: np.ndarray  # unit vectors of the benchmark's passages
    owner: np.ndarray  # each passage's item
    parts: list[np.ndarray]  # each passage's distinct words
    held: np.ndarray | None = None  # the same as a table, made where it is used
    weight: np.ndarray | None = None
    short: ShortItems | None = None


@dataclass
class ShortItems:
    places: np.ndarray  # in Index.items
    need: np.ndarray  # words of the item that a part which can be confirmed holds
    anchors: np.ndarray  # how many of them are among the item's rarest
    wide: np.ndarray  # words of such a part
    first: np.ndarray  # the first entry in `of` of each word, and the end
    of: np.ndarray  # items that have the word among their rarest
    held: np.ndarray  # item x word


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each text (one more: the end)."""
    cp, starts = tn.points([t.lower() for t in texts])
    a, b = tn.runs(tn.kinds()[cp] <= 3)
    return tn.hashes(tn.mixed(cp), a, b), tn.per_text(a, starts)


def _coded(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.value
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = hashed_words([x or "" for x in part.column(1).to_pylist()])
                at, known = tn.lookup(table, h)
                code = np.where(known, at, NONE).astype("<u4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([code[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["doc_id", "code"])

    return run


def _joined(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    raw = part.column(column).to_pylist()
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    return np.frombuffer(b"".join(raw), "<u4"), np.concatenate([[0], np.cumsum(lengths)])


def recoded(code: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Codes of the whole vocabulary as those of a part of it; ``own`` has one more entry for words outside."""
    return own[np.minimum(code, len(own) - 1)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, _ = hashed_words(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], names=["word"])


def _blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each run of ``STRIDE`` words, none across texts, and the first block of each text."""
    count = -(-np.diff(bounds) // STRIDE)
    starts = np.repeat(bounds[:-1], count) + tn.within(count) * STRIDE
    return starts, np.concatenate([[0], np.cumsum(count)])


def _frequencies(size: int):
    """Blocks that hold each word of the vocabulary; under -1 all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                code, bounds = _joined(batch.slice(at, 1000), "code")
                starts, _ = _blocks(bounds)
                total += len(starts)
                place = tn.within(np.diff(np.append(starts, len(code)))).astype(np.uint8)
                fresh = code != NONE  # and not in the same block before
                for k in range(1, STRIDE):
                    fresh[k:] &= (code[k:] != code[:-k]) | (place[k:] < k)
                df += np.bincount(code[fresh], minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int64)), pa.array(np.append(df[some], total))], names=["word", "n"])

    return run


def segment_sums(rows: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of ``rows[at]`` over the segments of ``at`` that begin at ``begin``: of ``STRIDE`` rows in their own type, of more in 64 bits."""
    while True:
        end = np.append(begin[1:], len(at))
        pieces = -(-(end - begin) // STRIDE)
        start = np.repeat(begin, pieces) + tn.within(pieces) * STRIDE
        length = np.minimum(np.repeat(end, pieces) - start, STRIDE)
        order = np.argsort((STRIDE - length).astype(np.uint8), kind="stable")
        start = start[order]
        longer = len(length) - np.cumsum(np.bincount(length, minlength=STRIDE + 1))
        sums = rows.take(at[start], axis=0)
        for j in range(1, STRIDE):
            sums[: longer[j]] += rows.take(at[start[: longer[j]] + j], axis=0)
        out = np.empty_like(sums)
        out[order] = sums
        if len(pieces) == len(start):
            return out
        rows, at, begin = out.astype(out.dtype.kind + "8"), np.arange(len(out)), np.cumsum(pieces) - pieces


def passages_of(code: np.ndarray, bounds: np.ndarray, rows: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each passage the sum of ``rows`` (a row a word) and the first word; and the first passage of each text.

    A passage is two blocks that follow each other, or a text's only block.
    """
    starts, first = _blocks(bounds)
    sums = np.zeros((len(starts), rows.shape[1]), np.float32)
    held = np.flatnonzero(code != NONE)
    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))[held]
    for at in range(0, len(held), GATHERED):
        mine = block[at : at + GATHERED]
        edge = np.flatnonzero(np.diff(mine, prepend=-1))
        sums[mine[edge]] += segment_sums(rows, code[held[at : at + GATHERED]], edge)
    n = np.diff(first)
    lone = np.repeat(n == 1, n)
    last = np.zeros(len(starts), bool)
    last[first[1:][n > 0] - 1] = True
    keep = ~last | lone
    two = sums.copy()
    two[:-1] += np.where(last[:-1, None], 0, sums[1:])
    counts = np.where(n > 1, n - 1, n)
    return two[keep], starts[keep], np.concatenate([[0], np.cumsum(counts)])


def _sketch(rows):
    """Sum over blocks of a (a . R), a the counts of a block's words: a row of whole numbers for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = rows.value
        out = np.zeros(r.shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                code, bounds = _joined(batch.slice(at, 200), "code")
                starts, _ = _blocks(bounds)
                held = np.flatnonzero(code != NONE)
                block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))[held]
                begin = np.flatnonzero(np.diff(block, prepend=-1))
                # whole blocks, about FITTED words of them at once
                cuts = np.unique(begin[np.searchsorted(begin, np.arange(0, len(held), FITTED), side="right") - 1])
                for a, b in zip(cuts, np.append(cuts[1:], len(held))):
                    word = code[held[a:b]].astype(np.int64)
                    edge = np.flatnonzero(np.diff(block[a:b], prepend=-1))
                    y = segment_sums(r, word, edge)
                    place = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(word))))
                    order = np.argsort(word)
                    word = word[order]
                    first = np.flatnonzero(np.diff(word, prepend=-1))
                    out[word[first]] += segment_sums(y, place[order], first)
        some = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, out[some].T)], names=["word", *_columns(r.shape[1])])

    return run


def _columns(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)]


def latent_space(passages: list[tuple[DataFrame, float]], idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF rows of all passages: tables (code), each with the weight of its rows.

    The sums are of whole numbers, so that neither the order of rows nor their tasks change the space.
    """
    spark = passages[0][0].sparkSession
    rng = np.random.default_rng(SEED)
    size = len(idf)
    q, _ = np.linalg.qr(rng.normal(size=(size, min(DIMENSIONS + OVERSAMPLED, size))))
    names = _columns(q.shape[1])
    words = [max(1, (table.agg(F.sum(F.length("code"))).first()[0] or 0) // 4) for table, _ in passages]
    for _ in range(ROUNDS):
        g = np.zeros_like(q)
        rows = q * idf[:, None]
        for (table, weight), n in zip(passages, words):
            # a sum is of at most n blocks' sums of STRIDE rows
            scale = 2.0 ** min(BITS, 62 - (STRIDE * n).bit_length()) / np.abs(rows).max()
            with sent(spark, np.rint(rows * scale).astype(np.int32)) as held:
                # a row a word of the vocabulary
                sums = table.select("code").mapInArrow(_sketch(held), ", ".join(f"{c} long" for c in ["word", *names])).groupBy("word").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
            g[sums.column("word").to_numpy()] += weight / scale * np.column_stack([sums.column(c).to_numpy() for c in names])
        g *= idf[:, None]
        q, _ = np.linalg.qr(g)
    b = q.T @ g
    values, turn = np.linalg.eigh((b + b.T) / 2)
    return q @ turn[:, np.argsort(-values)[:DIMENSIONS]]


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit a word of the item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def aligned(item: Item, text: np.ndarray) -> tuple[float, float]:
    """The best share of the item that a part of ``text`` about as long covers, and of its answer that this part holds."""
    n = len(item.words)
    wide = n if n < SHORT else int(1.3 * n)
    if np.isin(item.words, text).mean() < PARAPHRASED or common_subsequence(item.words, text) < PARAPHRASED * n:
        return 0.0, 0.0
    best = (0.0, 0.0)
    for a in range(0, max(1, len(text) - n + 1), max(1, n // 8) if n >= SHORT else 1):
        part = text[a : a + wide]
        share = common_subsequence(item.words, part) / n
        if share > best[0]:
            best = (share, float(np.isin(item.answer, part).mean()))
    return best


def confirmed(item: Item, share: float, answer: float) -> bool:
    if len(item.words) < SHORT:
        return share == 1.0
    return share >= COVERED or share >= PARAPHRASED and answer >= ANSWERED


def in_common(index: Index, code: np.ndarray, at: np.ndarray, end: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Of each benchmark passage the share of its weight in words that the text has from ``at``, not beyond ``end``."""
    if index.held is None:
        index.held = np.zeros((len(index.passages), len(index.idf)), bool)
        index.held[np.repeat(np.arange(len(index.parts)), [len(p) for p in index.parts]), np.concatenate(index.parts)] = True
        index.weight = index.held @ index.idf
    total = np.zeros(len(at))
    seen = []
    for k in range(PASSAGE):
        word = np.where(at + k < end, code[np.minimum(at + k, len(code) - 1)], NONE)
        word = np.where(word == NONE, len(index.idf) - 1, word)
        fresh = index.held[passage, word]
        for other in seen:
            fresh &= word != other
        seen.append(word)
        total += index.idf[word] * fresh
    return total / index.weight[passage]


def short_items(index: Index) -> ShortItems:
    """Items of fewer than ``PASSAGE`` words, by the rarest of their words.

    A part holds at least ``need`` words of an item. All but ``need - anchors`` of the
    item's words are listed, the rarest first; so the part holds ``anchors`` of these.
    """
    if index.short is None:
        places = np.array([o for o, x in enumerate(index.items) if 0 < len(x.words) < PASSAGE], np.int64)
        n = np.array([len(index.items[o].words) for o in places], np.int64)
        need = np.where(n < SHORT, n, np.ceil(PARAPHRASED * n - 1e-9)).astype(np.int64)
        anchors = np.minimum(ANCHORS, need)
        held = np.zeros((len(places), len(index.idf)), bool)
        listed = np.zeros_like(held)
        for s, o in enumerate(places):
            words = index.items[o].words
            held[s, words] = True
            listed[s, words[np.argsort(-index.idf[words], kind="stable")[: n[s] - need[s] + anchors[s]]]] = True
        word, of = np.nonzero(listed.T)
        first = np.searchsorted(word, np.arange(len(index.idf) + 1))
        index.short = ShortItems(places, need, anchors, np.where(n < SHORT, n, (1.3 * n).astype(np.int64)), first, of.astype(np.uint16), held)
    return index.short


def short_regions(index: Index, code: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, begin and end of each region with a part in which a short item could be confirmed."""
    known = short_items(index)
    word = np.where(code == NONE, len(index.idf) - 1, code).astype(np.int64)
    count = known.first[word + 1] - known.first[word]
    some = np.flatnonzero(count)
    count = count[some]
    item = known.of[np.repeat(known.first[word[some]], count) + tn.within(count)]
    order = np.argsort(item, kind="stable")
    item, at = item[order].astype(np.int64), np.repeat(some, count)[order]
    last = np.arange(len(at)) + known.anchors[item] - 1
    inside = last < len(at)
    last = np.minimum(last, len(at) - 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    near = np.flatnonzero(inside & (item[last] == item) & (text[at[last]] == text[at]) & (at[last] - at < known.wide[item]))
    if not len(near):
        return
    item, text, wide = item[near], text[at[near]], known.wide[item[near]]
    begin, end = np.maximum(bounds[text], at[last[near]] - wide + 1), np.minimum(bounds[text + 1], at[near] + wide)
    ok = np.zeros(len(near), bool)
    across = np.arange(2 * int(wide.max()))
    for k in range(0, len(near), COUNTED):
        s = slice(k, k + COUNTED)
        place = begin[s, None] + across
        has = known.held[item[s, None], word[np.minimum(place, len(word) - 1)]] & (place < end[s, None])
        sums = np.concatenate([np.zeros((len(has), 1), np.int64), np.cumsum(has, axis=1)], axis=1)
        ends = np.minimum(across + wide[s, None], len(across))
        ok[s] = (np.take_along_axis(sums, ends, axis=1) - sums[:, :-1] >= known.need[item[s], None]).any(axis=1)
    item, text, begin, end = item[ok], text[ok], begin[ok], end[ok]
    if not len(item):
        return
    # regions of one item that overlap are one
    fresh = np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (begin[1:] > np.maximum.accumulate(end + item * (len(code) + 1))[:-1] - item[1:] * (len(code) + 1))])
    starts = np.flatnonzero(fresh)
    yield from zip(text[starts].tolist(), known.places[item[starts]].tolist(), begin[starts].tolist(), np.maximum.reduceat(end, starts).tolist())


def cosine_of(index: Index, item: int, code: np.ndarray) -> float:
    """The largest cosine of the words ``code`` with a passage of the item."""
    v = index.basis[code[code != NONE]].sum(axis=0)
    return float((index.passages[index.owner == item] @ (v / max(float(np.linalg.norm(v)), 1e-9))).max(initial=0.0))


def search(index: Index, code: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    """Text, item, cosine, share covered and share of the answer of each confirmed pair."""
    x, starts, first = passages_of(code, bounds, index.basis, index.idf)
    norm = np.linalg.norm(x, axis=1)
    x /= np.maximum(norm, 1e-9)[:, None]
    candidates: dict[tuple[int, int], list] = {}
    for at in range(0, len(x), 4096):
        cos = x[at : at + 4096] @ index.passages.T
        i, j = np.divmod(np.flatnonzero(cos >= CANDIDATE), cos.shape[1])
        text = np.searchsorted(first, i + at, side="right") - 1
        near = in_common(index, code, starts[i + at], bounds[text + 1], j) >= IN_COMMON
        i, j, text = i[near], j[near], text[near]
        for t, p, o, c in zip(text.tolist(), (i + at).tolist(), index.owner[j].tolist(), cos[i, j].tolist()):
            candidates.setdefault((t, o), []).append((p, c))
    regions: dict[tuple[int, int], list] = {}
    for t, o, a, b in short_regions(index, code, bounds):
        regions.setdefault((t, o), []).append((a, b))
        candidates.setdefault((t, o), [])
    for (t, o), found in candidates.items():
        item = index.items[o]
        n, best, done = len(item.words), (0.0, 0.0), -1
        for p, _ in sorted(found):
            a, b = max(int(bounds[t]), int(starts[p]) - n), min(int(bounds[t + 1]), int(starts[p]) + PASSAGE + n)
            if p == done:
                continue
            done = p
            best = max(best, aligned(item, code[a:b]))
            if best[0] == 1.0:
                break
        cosine = max((c for _, c in found), default=None)
        for a, b in regions.get((t, o), []):
            if best[0] == 1.0:
                break
            best = max(best, aligned(item, code[a:b]))
            cosine = cosine_of(index, o, code[a:b]) if cosine is None else cosine
        if confirmed(item, *best):
            yield t, o, cosine, *best


def _searched(parts):
    types = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("covered", pa.float64()), ("answered", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 1000):
                code, bounds = _joined(batch.slice(at, 1000), "code")
                for own, known in parts.value:
                    rows = [(ids[at + t], known.items[o].item_id, c, share, answer) for t, o, c, share, answer in search(known, recoded(code, own), bounds)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)
            tidy()

    return run


def _index(rows: list, vocabulary: np.ndarray, weights: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, Index] | None:
    """The index of the items ``rows`` (item_id, text), and the numbers that its words have in it; ``weights``: the idf of all words and of others."""
    h, bounds = hashed_words([r["text"] for r in rows])
    words = np.unique(h)
    if not len(words):
        return None
    own = np.full(len(vocabulary) + 1, NONE, np.uint32)
    at = np.searchsorted(vocabulary, words)
    own[at] = np.arange(len(words))
    code = np.searchsorted(words, h).astype(np.uint32)
    idf = np.append(weights[at], weights[-1])
    items = []
    for r, a, b in zip(rows, bounds[:-1], bounds[1:]):
        mine = code[a:b]
        rare = np.unique(mine)
        items.append(Item(r["item_id"], mine, rare[np.lexsort((rare, -idf[rare]))][:ANSWER_WORDS]))
    basis = (space[at] * idf[:-1, None]).astype(np.float32)
    vectors, begin, first = passages_of(code, bounds, basis, idf)
    norm = np.linalg.norm(vectors, axis=1)
    owner = np.repeat(np.arange(len(items)), np.diff(first))
    some = norm > 1e-6
    ends = np.minimum(begin + PASSAGE, bounds[1:][owner])
    parts = [np.unique(code[a:b]) for a, b in zip(begin[some], ends[some])]
    return own, Index(words, items, idf, basis, (vectors[some] / norm[some, None]).astype(np.float32), owner[some], parts)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, covered, answered``: a row for each item that a document holds."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], "doc_id long, item_id long, cosine double, covered double, answered double")
    items = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("text <> ''").distinct(), "decontaminate-items")
    # the benchmark's distinct words, eight bytes each
    vocabulary = np.sort(items.select("text").mapInArrow(_words, "word long").distinct().toArrow().column("word").to_numpy().view(np.uint64))
    if not len(vocabulary):
        return none
    with sent(spark, vocabulary) as held:
        coded = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_coded(held), "doc_id long, code binary"), "decontaminate-coded")
        coded_items = cut(items.mapInArrow(_coded(held), "doc_id long, code binary").where(F.length("code") > 0), "decontaminate-coded-items")
    counted = coded.select("code").mapInArrow(_frequencies(len(vocabulary)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = counted.column("word").to_numpy(), counted.column("n").to_numpy()
    df, total = np.zeros(len(vocabulary)), max(1, int(n[word < 0].sum()))
    df[word[word >= 0]] = n[word >= 0]
    idf = np.append(np.log((total + 1) / (df + 1)) + 1e-3, np.log(total + 1))
    space = latent_space([(coded, DOCUMENTS * coded_items.count() / max(1, coded.count())), (coded_items, 1.0)], idf[:-1])
    parts = -(-items.count() // ITEMS_AT_ONCE)
    out, group = none, []
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        group.append(_index(mine.orderBy("item_id", "text").collect(), vocabulary, idf, space))  # about ITEMS_AT_ONCE items
        if k + 1 == parts or len(group) == PARTS_AT_ONCE:
            known = [x for x in group if x is not None]
            group = []
            tidy()
            if known:
                with sent(spark, known) as held:
                    found = cut(coded.mapInArrow(_searched(held), none.schema), "decontaminate-found", keep=True)
                out = found if out is none else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max(F.struct("covered", "answered")).alias("x")).select("doc_id", "item_id", "cosine", "x.covered", "x.answered")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept; rows with one ``doc_id`` or none are judged each by its text."""
    with scratch(docs.sparkSession):
        bad = cut(contaminated(docs.select(row_key().alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__key")).distinct(), "decontaminate-bad", keep=True)
    return docs.withColumn("__key", row_key()).join(bad, "__key", "left_anti").select(*docs.columns)
