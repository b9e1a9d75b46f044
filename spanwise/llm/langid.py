"""Language of a text by known words first, then by ever shorter letter n-grams.

A word is a run of letters, lower-cased. A known word scores the logarithm of its
smoothed share among each language's words. An unknown word scores the mean of its
known letter 5-grams, else of its 4-grams, and so on down to single letters. A
text's score for a language is the sum over its words.

Defined cases: null text and text without letters are ``und`` with score 0; rows
with a null ``lang`` or ``doc_id`` teach nothing; without any labelled row all is
``und``; ties go to the language that sorts first; repeated rows are each
answered; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .shared import cut, scratch
from .token_store import slices

#: Documents of each language that the model is fitted on, by order of a hash of doc_id.
FIT_DOCS_PER_LANGUAGE = 3000
#: Letters of the longest n-gram, and how often a word or n-gram stands in the sample at least to be known.
LONGEST, LEAST_COUNT = 5, 3
SMOOTHING = 0.5
#: Words that the evidence of an endless text counts for, as its words do not speak for themselves; a short text's count nearly whole.
SURE_WORDS = 12


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # sorted hashes: words, then n-grams of length 1, 2, ...
    logs: list[np.ndarray]  # a row a key, a column a language


def _words(texts: list[str]):
    cp, bounds = tn.points([t.lower() for t in texts])
    starts, ends = tn.runs(tn.letters()[cp])
    values = tn.mixed(cp)
    return values, bounds, starts, ends, tn.hashes(values, starts, ends)


def _count(languages: list[str]):
    code = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                texts = [x or "" for x in part.column(0).to_pylist()]
                langs = np.array([code[x] for x in part.column(1).to_pylist()])
                values, bounds, starts, ends, words = _words(texts)
                lang = np.repeat(langs, np.diff(tn.per_text(starts, bounds)))
                for l in np.unique(lang).tolist():
                    mine = np.flatnonzero(lang == l)
                    keys, first, counts = np.unique(words[mine], return_index=True, return_counts=True)
                    found = [(0, keys, counts)]
                    types = mine[first]  # one of each word: n-grams are counted over the vocabulary
                    for n in range(1, LONGEST + 1):
                        grams, _ = tn.ngrams(values, starts[types], (ends - starts)[types], n)
                        found.append((n, *np.unique(grams, return_counts=True)))
                    for n, k, c in found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int32)), pa.array(k.view(np.int64)), pa.array(np.full(len(k), l, np.int32)), pa.array(c.astype(np.int64))], names=["n", "key", "l", "c"])

    return run


def fit(docs: DataFrame, teaches: Column) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) where ``teaches`` holds.

    Of each language the documents with the least hashes are read, about
    ``FIT_DOCS_PER_LANGUAGE``; all counting is distributed, and of the counts those
    of at least ``LEAST_COUNT`` leave it, which the sample bounds.
    """
    rows = docs.where(teaches & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(found)
    if not languages:
        return Model([], [np.empty(0, np.uint64)] * (LONGEST + 1), [np.empty((0, 0))] * (LONGEST + 1))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, FIT_DOCS_PER_LANGUAGE / found[lang]))])
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    sample = rows.where(uniform <= share[F.col("lang")]).select("text", "lang")
    counts = cut(sample.mapInArrow(_count(languages), "n int, key long, l int, c long").groupBy("n", "key").agg(*[F.sum(F.when(F.col("l") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(len(languages))]), "langid-counts")
    total = sum((F.col(f"c{i}") for i in range(len(languages))), F.lit(0))
    sizes = {r["n"]: r for r in counts.groupBy("n").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(languages))], F.count(F.lit(1)).alias("kinds")).collect()}
    keys, logs = [], []
    for n in range(LONGEST + 1):
        top = counts.where((F.col("n") == n) & (total >= LEAST_COUNT)).drop("n").toArrow()
        k = top.column("key").to_numpy().view(np.uint64)
        order = np.argsort(k)
        c = np.stack([top.column(f"c{i}").to_numpy() for i in range(len(languages))], axis=1).astype(np.float64)[order]
        whole = np.array([sizes[n][f"c{i}"] if n in sizes else 0 for i in range(len(languages))], np.float64)
        keys.append(k[order])
        logs.append(np.log((c + SMOOTHING) / (whole + SMOOTHING * (len(k) + 1))))
    return Model(languages, keys, logs)


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean log share a word by language, and the number of words, of each text."""
    values, bounds, starts, ends, words = _words(texts)
    each = np.zeros((len(words), len(model.languages)))
    at, known = tn.lookup(model.keys[0], words)
    each[known] = model.logs[0][at[known]]
    open_ = np.flatnonzero(~known)
    if len(open_):
        # the same unknown word is scored once
        kinds, first, back = np.unique(words[open_], return_index=True, return_inverse=True)
        word = open_[first]
        score, left = np.zeros((len(kinds), each.shape[1])), np.arange(len(kinds))
        for n in range(LONGEST, 0, -1):
            grams, owner = tn.ngrams(values, starts[word[left]], (ends - starts)[word[left]], n)
            at, known = tn.lookup(model.keys[n], grams)
            at, owner = at[known], owner[known]
            hits = np.bincount(owner, minlength=len(left))
            for l in range(each.shape[1]):
                score[left, l] += np.bincount(owner, model.logs[n][at, l], len(left)) / np.maximum(hits, 1)
            left = left[hits == 0]
            if not len(left):
                break
        each[open_] = score[back]
    of = tn.per_text(starts, bounds)
    n = np.diff(of)
    return tn.sums(each, of) / np.maximum(n, 1)[:, None], n


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x or "" for x in part.column(1).to_pylist()]
                mean, n = scores(m, texts)
                if m.languages:
                    z = mean * (n * SURE_WORDS / (n + SURE_WORDS))[:, None]
                    z = np.exp(z - z.max(axis=1, keepdims=True))
                    z /= z.sum(axis=1, keepdims=True)
                    best = z.argmax(axis=1)
                    lang = [m.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist())]
                    sure = np.where(n > 0, z[np.arange(len(z)), best], 0.0)
                else:
                    lang, sure = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(sure)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_predict(sent), "doc_id long, lang_pred string, score double")


def fold(n: int) -> Column:
    """crc32 of doc_id as text modulo ``n``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learnt from fold 0, 1 and 3 of four."""
    with scratch(docs.sparkSession):
        model = fit(docs, fold(4) != 2)
    return predict(docs, model).withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
