"""Token ids as a content-addressed binary store.

Layout of a store, all under one folder and all Parquet:

``records``
    One row a document in ascending ``doc_id`` order: its recipe (digests and id
    counts of its chunks), and the payload of each chunk that it owns.
    A chunk's payload is stored once in the whole store, whatever the number of
    recipes that name it, with the first of those documents that were staged with it. ``shard`` and ``ordinal`` give the document's place.
``manifest``
    One row a shard: its documents, its ids, and the root of the Merkle tree over
    the document digests in order.

A payload is a zstd frame of the ids as little-endian unsigned integers of
``width`` bytes. A chunk's digest is BLAKE2b-128 over its ids as little-endian
32-bit integers, a document's digest is that over its chunks' digests and counts.

Chunks end where a rolling hash of the last 16 ids has ``AVERAGE_BITS`` zero
bits, so a passage that two documents share gives the same chunks in both.

Defined cases: null text is empty text (its ids are the end id alone); rows with
the same ``doc_id`` are separate records, ordered by content; a null ``doc_id``
sorts first; an empty table gives an empty store; other columns are not kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, cut_at, drop, shared_dir, tidy

WINDOW = 16
AVERAGE_BITS = 11
SHORTEST, LONGEST = 512, 8192
SHARD_TOKENS = 8_000_000
BATCH_CHARS = 1_000_000
#: Bytes of text whose words are numbered at once, and words that are cut into chunks at once.
ENCODED_CHARS, CUT_WORDS = 6_000_000, 100_000
#: Entries that a Python worker remembers of words and of word pieces before it starts anew.
REMEMBERED_WORDS, REMEMBERED_PIECES = 200_000, 450_000
#: Hot keys that make up a task's share of rows at least, rows of a hot key at least, and parts that rows of a hot key are dealt into.
HOT_PER_TASK, HOT_LEAST, SALTS = 20, 50, 16
#: Stands between words that are cut into pieces together.
MARK = " \0 "

STAGED = "doc_id long, row_id long, doc_digest binary, n_tokens long, digests array<binary>, counts array<int>, payloads array<binary>"
RECORD = "shard int, ordinal long, doc_id long, n_tokens long, doc_digest binary, digests array<binary>, counts array<int>, own array<int>, own_shared array<boolean>, payloads array<binary>, width int"


def numbered(known: dict[str, int], keys: list[str]) -> tuple[np.ndarray, list[str]]:
    """The numbers of distinct ``keys``, those not yet ``known`` numbered on, and these."""
    codes = np.fromiter(map(known.get, keys, repeat(-1)), np.int64, len(keys))
    late = np.flatnonzero(codes < 0)
    new = [keys[i] for i in late.tolist()]
    codes[late] = np.arange(len(known), len(known) + len(new))
    known.update(zip(new, codes[late].tolist()))
    return codes, new


class Rows:
    """Growing ragged array of ids; row ``k`` is ``flat[start[k]:start[k] + length[k]]``."""

    def __init__(self):
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.length, self.n = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32), 0

    @staticmethod
    def _room(x: np.ndarray, need: int) -> np.ndarray:
        return x if need <= len(x) else np.concatenate([x, np.empty(max(need, len(x) * 2) - len(x), x.dtype)])

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used + len(ids))
        self.start, self.length = self._room(self.start, self.n + len(lengths)), self._room(self.length, self.n + len(lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(lengths)] = lengths
        self.used, self.n = self.used + len(ids), self.n + len(lengths)

    def keep(self, n: int) -> None:
        """Drop all rows from the n-th on."""
        if n < self.n:
            self.n, self.used = n, int(self.start[n])

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after another, and each row's length."""
        lengths = self.length[codes]
        ends = np.cumsum(lengths, dtype=np.int32)
        at = np.repeat(self.start[codes] - (ends - lengths), lengths)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], lengths


class Encoder:
    """Encodes texts with a tokenizers file, each distinct word once.

    Where the file lower-cases and cuts words at white space, the ids of a text
    are those of its words one after another. Words of letters below U+0180 are
    cut further into the pieces of the file's own pattern. Any other file or word
    goes to the library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path) as f:
            said = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        steps = [x.get("type") for x in (said.get("normalizer") or {}).get("normalizers", [])]
        split = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") and said["model"].get("end_of_word_suffix") == "</w>"
        if self.by_word:
            self.pattern = regex.compile(split["pattern"]["Regex"])
            self.special = tuple(x["content"] for x in said["added_tokens"])
            # pieces are cut and lower-cased: the same model without those steps
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.vocabulary, bool)
            for token, i in self.library.get_vocab().items():
                self.last[i] = token.endswith("</w>")
        self.words, self.word_ids = {}, Rows()
        self.pieces, self.piece_ids = {}, Rows()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, found: list[str]) -> None:
        _, new = numbered(self.pieces, list(dict.fromkeys(found)))
        if not new:
            return
        ids = np.array(self.bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(new) and ends[-1] == len(ids):
            lengths = np.diff(ends, prepend=0)
        else:
            each = self._library(new)
            ids, lengths = np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)
        self.piece_ids.add(ids, lengths)

    def _learn_words(self, new: list[str]) -> None:
        if not new:
            return
        joined = MARK.join(new)
        whole = np.zeros(len(new), bool)  # words that go to the library as they are
        if np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).max(initial=0) >= 0x180 or "İ" in joined or joined.count(MARK) != len(new) - 1 or any(s in joined for s in self.special):
            whole[:] = [not w.isascii() and (max(w) >= "ƀ" or "İ" in w) or "\0" in w or any(s in w for s in self.special) for w in new]
            joined = MARK.join("" if x else w for w, x in zip(new, whole.tolist()))
        found = self.pattern.findall(joined.lower())
        self._learn_pieces(found)
        codes = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        mark = codes == self.pieces["\0"] if len(new) > 1 else np.zeros(len(codes), bool)
        word = np.cumsum(mark)[~mark]  # of each piece the word that it belongs to
        ids, lengths = self.piece_ids.take(codes[~mark])
        sizes = np.bincount(word, weights=lengths, minlength=len(new)).astype(np.int64)
        if whole.any():
            each = dict(zip(np.flatnonzero(whole).tolist(), self._library([w for w, x in zip(new, whole.tolist()) if x])))
            ends = np.cumsum(sizes)
            ids = np.concatenate([np.array(each[k], np.int32) if k in each else ids[ends[k] - sizes[k] : ends[k]] for k in range(len(new))])
            for k, x in each.items():
                sizes[k] = len(x)
        self.word_ids.add(ids, sizes)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The texts (no nulls) in groups: the first one's index, their ids one after another, the number of each one's."""
        if not self.by_word:
            each = self._library(texts.to_pylist())
            yield 0, np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)
            return
        if len(self.words) > REMEMBERED_WORDS:
            self.words, self.word_ids = {}, Rows()
        if len(self.pieces) > REMEMBERED_PIECES:
            self.pieces, self.piece_ids = {}, Rows()
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        coded = split.flatten().dictionary_encode()
        # words hold no space: joined and split they become Python strings at once
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ") if len(coded) else []
        words, at = coded.indices.to_numpy(), 0
        codes = np.fromiter(map(self.words.get, distinct, repeat(-1)), np.int64, len(distinct))
        late = np.flatnonzero(codes < 0)
        # a word that stands here only once is not worth remembering
        often = np.bincount(words, minlength=len(distinct))[late] > 1
        late, held = np.concatenate([late[often], late[~often]]), self.word_ids.n + int(often.sum())
        codes[late] = np.arange(self.word_ids.n, self.word_ids.n + len(late))
        new = [distinct[i] for i in late.tolist()]
        self.words.update(zip(new, range(self.word_ids.n, held)))
        self._learn_words(new)
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CUT_WORDS, side="right")) - 1)
            mine = words[bounds[at] : bounds[to]]
            ids, lengths = self.word_ids.take(codes[mine]) if len(mine) else (np.empty(0, np.int32), np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            yield at, ids, np.diff(ends[bounds[at : to + 1] - bounds[at]])
            at = to
        self.word_ids.keep(held)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a file and Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Free what encoders remember: a worker that has encoded goes on to other work."""
    if _encoders:
        import gc

        _encoders.clear()
        gc.collect()
        tidy()


_salts = np.empty(0, np.uint32)


def salts(n: int) -> np.ndarray:
    """A well-spread 32-bit number for each of the ids below ``n`` at least, by SplitMix64."""
    global _salts
    if len(_salts) < n:
        x = np.arange(1, max(n, 1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        _salts = (x >> np.uint64(32)).astype(np.uint32)
    return _salts


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place a 32-bit hash of the ``WINDOW`` ids that end there (fewer at the start)."""
    h, span = salts(int(ids.max(initial=0)) + 1)[ids], 1
    while span < WINDOW:
        later = h.copy()
        later[span:] += h[:-span] * np.uint32(pow(0x5851F42D, span, 1 << 32))
        h, span = later, span * 2
    return h


def cut_points(ids: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """The chunk ends of each document, relative to its start; the last is its length."""
    marks = np.flatnonzero(rolling(ids) >> np.uint32(32 - AVERAGE_BITS) == 0) + 1
    out, begin = [], 0
    for n in lengths.tolist():
        inside = (marks[np.searchsorted(marks, begin + SHORTEST) : np.searchsorted(marks, begin + n)] - begin).tolist()
        ends, at = [], 0
        for m in inside:
            while m - at > LONGEST:
                at += LONGEST
                ends.append(at)
            if m - at >= SHORTEST:
                at = m
                ends.append(at)
        while n - at > LONGEST:
            at += LONGEST
            ends.append(at)
        ends.append(n)
        out.append(ends)
        begin += n
    return out


def chunk_digest(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(ids, "<u4"), digest_size=16).digest()


def document_digest(digests: list[bytes], counts: list[int]) -> bytes:
    return hashlib.blake2b(b"".join(digests) + np.array(counts, "<u4").tobytes(), digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Leaves and inner nodes are hashed with different prefixes; an odd node moves up."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.blake2b(b"", digest_size=16).digest()


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``most`` bytes of text, a document at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
    tidy()


def _stage(path: str, end_id: int, width: int):
    types = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("doc_digest", pa.binary()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("payloads", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        encode, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text", ENCODED_CHARS):
                doc_ids = part.column(0).to_pylist()
                for first, bare, n in encode(pc.fill_null(part.column(1), "")):
                    ids = np.insert(bare, np.cumsum(n), end_id)
                    n = n + 1
                    rows: list[list] = [[], [], [], [], [], [], []]
                    begin, given = 0, set()
                    for doc_id, m, cuts in zip(doc_ids[first : first + len(n)], n.tolist(), cut_points(ids, n)):
                        digests, counts, payloads, at = [], [], [], 0
                        for end in cuts:
                            chunk = ids[begin + at : begin + end]
                            digest = chunk_digest(chunk)
                            digests.append(digest)
                            counts.append(end - at)
                            # a chunk that this group of texts has given before goes without its payload
                            payloads.append(None if digest in given else pack.compress(chunk.astype(f"<u{width}").tobytes()))
                            given.add(digest)
                            at = end
                        for column, x in zip(rows, (doc_id, row, document_digest(digests, counts), m, digests, counts, payloads)):
                            column.append(x)
                        begin, row = begin + m, row + 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, types)], schema=types)

    return run


def _record(width: int):
    types = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_digest", pa.binary()), ("digests", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("own", pa.list_(pa.int32())), ("own_shared", pa.list_(pa.bool_())), ("payloads", pa.list_(pa.binary())), ("width", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_encoders()
        shard, ordinal, before = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            # a document's repeated chunks stand in a row just before it, perhaps in the batch before
            repeats = [*before, *batch.column("repeats").to_pylist()]
            is_doc = np.array([r is None for r in repeats[len(before) :]], bool)
            docs = batch.filter(pa.array(is_doc))
            n = docs.num_rows
            payloads = docs.column("payloads")
            bounds = payloads.offsets.to_numpy() - payloads.offsets[0].as_py()
            owned, shared = np.ones(bounds[-1], bool), np.zeros(bounds[-1], bool)
            k = 0
            for i, r in enumerate(repeats):
                if i >= len(before) and is_doc[i - len(before)]:
                    k += 1
                elif r is not None and k < n:
                    for x in r:
                        shared[bounds[k] + x["pos"]] = True
                        owned[bounds[k] + x["pos"]] = x["first"]
            before = repeats[-1:] if repeats and repeats[-1] is not None else []
            if not n:
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(owned)])[bounds].astype(np.int32))
            place = (np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.int32)
            keep = pa.array(owned)
            columns = [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(ordinal, ordinal + n)), docs.column("doc_id"), docs.column("n_tokens"), docs.column("doc_digest"), docs.column("digests"), docs.column("counts")]
            columns += [pa.ListArray.from_arrays(offsets, flat.filter(keep)) for flat in (pa.array(place), pa.array(shared), payloads.flatten())]
            columns.append(pa.array(np.full(n, width, np.int32)))
            ordinal += n
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, types)], schema=types)

    return run


def _vocabulary(spark: SparkSession, path: str) -> int:
    """How many ids the tokenizer has, told by a task: the driver holds no tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)]})
        tidy()

    return spark.range(1, numPartitions=1).mapInArrow(run, "n long").first()["n"]


def hot_and_cold(total: int, counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``counted`` (``n`` rows of ``total`` each) in two: keys that would fill a good part of a task, and the others.

    A key is hot with over ``1 / HOT_PER_TASK`` of a task's share of the rows, so there are
    at most ``HOT_PER_TASK`` times as many hot keys as tasks.
    """
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(HOT_LEAST, total // (HOT_PER_TASK * tasks))
    return counted.where(F.col("n") > most), counted.where(F.col("n") <= most)


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write the store under ``path``."""
    spark = docs.sparkSession
    width = 2 if _vocabulary(spark, tokenizer) <= 1 << 16 and end_id < 1 << 16 else 4
    staged, staging = cut_at(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_stage(tokenizer, end_id, width), STAGED), "token-stage")
    total = staged.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))

    given = F.transform("payloads", lambda p: p.isNotNull())
    refs = staged.select("doc_id", "doc_digest", "row_id", F.posexplode(F.arrays_zip(F.col("digests").alias("digest"), given.alias("given"))).alias("pos", "c")).select("doc_id", "doc_digest", "row_id", "pos", "c.digest", "c.given")
    place = F.struct("doc_id", "doc_digest", "row_id", "pos")
    several = refs.groupBy("digest").agg(F.min(F.when(F.col("given"), place)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several, counted = cut_at(several, "token-several")
    hot, cold = hot_and_cold(refs.count(), several)
    wanted = refs.select("doc_id", "doc_digest", "row_id", "pos", "digest")
    marked = wanted.join(F.broadcast(hot.select("digest", "first")), "digest", "left")  # at most HOT_PER_TASK digests a task
    known = marked.where("first IS NOT NULL").unionByName(marked.where("first IS NULL").drop("first").join(cold.select("digest", "first"), "digest"))
    repeats = known.groupBy("doc_id", "doc_digest", "row_id").agg(F.collect_list(F.struct("pos", (F.col("first.row_id").eqNullSafe(F.col("row_id")) & (F.col("first.pos") == F.col("pos"))).alias("first"))).alias("repeats"))
    both = staged.unionByName(repeats, allowMissingColumns=True)
    order = ["doc_id", "doc_digest", "row_id"]
    ordered = both.repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("repeats").isNull())
    ordered.mapInArrow(_record(width), RECORD).write.parquet(f"{path}/records")
    drop(spark, staging)
    drop(spark, counted)
    _manifest(spark.read.schema(RECORD).parquet(f"{path}/records")).write.parquet(f"{path}/manifest")


def _manifest(records: DataFrame) -> DataFrame:
    def root(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("ordinal")
        return pd.DataFrame({"shard": [key[0]], "n_docs": [len(pdf)], "n_tokens": [int(pdf["n_tokens"].sum())], "merkle_root": [merkle_root([bytes(x) for x in pdf["doc_digest"]]).hex()]})

    return records.select("shard", "ordinal", "n_tokens", "doc_digest").groupBy("shard").applyInPandas(root, "shard int, n_docs long, n_tokens long, merkle_root string")


def _restored(summed: bool):
    """Each document's ids from its own chunks and those fetched, checked against the recipe; or only their checksum."""
    last = ("ids_crc32", pa.int64()) if summed else ("ids", pa.binary())
    types = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_digest", pa.binary()), ("whole", pa.bool_()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        forget_encoders()
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows: list[list] = [[] for _ in types]
                part = batch.slice(at, 500)
                names = ("shard", "ordinal", "doc_id", "n_tokens", "digests", "counts", "own", "payloads", "fetched", "width")
                for shard, ordinal, doc_id, n, named, sizes, own, payloads, fetched, width in zip(*(part.column(c).to_pylist() for c in names)):
                    parts = dict(zip(own, payloads))
                    for r in fetched or ():
                        parts[r["pos"]] = r["payload"]
                    chunks = [np.frombuffer(unpack.decompress(parts[i]), f"<u{width}").astype("<u4") if i in parts else np.empty(0, "<u4") for i in range(len(named))]
                    digests, counts = [chunk_digest(c) for c in chunks], [len(c) for c in chunks]
                    whole = digests == named and counts == sizes and sum(counts) == n
                    ids = chunks[0].data if len(chunks) == 1 else b"".join(c.tobytes() for c in chunks)
                    for column, v in zip(rows, (shard, ordinal, doc_id, sum(counts), document_digest(digests, counts), whole, zlib.crc32(ids) if summed else bytes(ids))):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, types)], schema=types)

    return run


RESTORED = "shard int, ordinal long, doc_id long, n_tokens long, doc_digest binary, whole boolean, "


def read_store(spark: SparkSession, path: str, summed: bool = False) -> DataFrame:
    """One row a document: its place, its ids (little-endian 32-bit; with ``summed`` their crc32), and whether all digests hold.

    Only documents that name a chunk of another document take part in a shuffle,
    and only with the chunks that several recipes name.
    """
    records = spark.read.schema(RECORD).parquet(f"{path}/records")
    complete = F.size("own") == F.size("digests")
    fetch = "array<struct<pos:int,payload:binary>>"
    alone = records.where(complete).withColumn("fetched", F.lit(None).cast(fetch))
    partial = records.where(~complete)
    wanted = partial.select("shard", "ordinal", "own", F.posexplode("digests").alias("pos", "digest")).where(~F.array_contains("own", F.col("pos"))).drop("own")
    chunks = records.where(F.exists("own_shared", lambda s: s)).select(F.explode(F.arrays_zip("own", "own_shared", "payloads")).alias("c"), "digests").where("c.own_shared").select(F.element_at("digests", F.col("c.own") + 1).alias("digest"), F.col("c.payloads").alias("payload"))
    counted = wanted.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    hot, _ = hot_and_cold(wanted.count(), counted)
    hot = hot.select("digest", F.lit(True).alias("hot"))
    # the rows of a hot digest are dealt into parts, and its chunk goes to each of them
    parts = F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))
    dealt = wanted.join(F.broadcast(hot), "digest", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.col("ordinal"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    copies = chunks.join(F.broadcast(hot), "digest", "left").withColumn("part", F.explode(parts)).drop("hot")
    fetched = dealt.join(copies, ["digest", "part"]).groupBy("shard", "ordinal").agg(F.collect_list(F.struct("pos", "payload")).alias("fetched"))
    gathered = partial.join(fetched, ["shard", "ordinal"], "left").select(*alone.columns)
    schema = RESTORED + ("ids_crc32 long" if summed else "ids binary")
    return alone.mapInArrow(_restored(summed), schema).unionByName(gathered.mapInArrow(_restored(summed), schema))


def digests_of(spark: SparkSession, path: str) -> DataFrame:
    """Read a store back and verify it: ``doc_id, start, n_tokens, ids_crc32, verified``.

    ``verified`` holds if every chunk and the recipe match their digests and the
    Merkle root over the document digests as read equals the shard's in the manifest.
    """
    read = cut(read_store(spark, path, summed=True), "token-read")
    manifest = spark.read.parquet(f"{path}/manifest")
    again = _manifest(read).select("shard", F.col("merkle_root").alias("root_read"))
    shards = manifest.join(again, "shard", "left").select("shard", (F.col("merkle_root") == F.col("root_read")).alias("sealed"), (F.sum("n_tokens").over(W.orderBy("shard")) - F.col("n_tokens")).alias("before"))
    inside = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("ordinal")) - F.col("n_tokens")
    return (
        read.withColumn("inside", inside)
        .join(shards, "shard")
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", (F.col("whole") & F.coalesce("sealed", F.lit(False))).alias("verified"))
    )


def encode_and_verify(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` as a store in the shared folder, read it back and return :func:`digests_of`."""
    path = shared_dir(docs.sparkSession, "token-store")
    write_store(docs, tokenizer, end_id, path, shard_tokens)
    return digests_of(docs.sparkSession, path)
