"""Scores of text pairs by a scorer that is loaded once a worker: each distinct pair once, failures as rows.

A scorer is built in the worker by a factory, from a registry or passed by the caller,
and takes two lists of texts. It may fail on a pair; then the pair is tried alone and its
row holds the error in place of a score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[list[str], list[str]], list[float]]
_factories: dict[str, Callable[[], Scorer]] = {}
_built: dict[str, Scorer] = {}


def register(name: str):
    """A decorator for a factory that builds a scorer in the worker."""

    def keep(factory: Callable[[], Scorer]):
        _factories[name] = factory
        return factory

    return keep


def factory_of(name: str) -> Callable[[], Scorer]:
    if name not in _factories:
        raise ValueError(f"no scorer {name!r}; there are {sorted(_factories)}")
    return _factories[name]


@register("mock")
def _mock() -> Scorer:
    """Scores from a hash of the texts, the same everywhere; for dry runs."""
    return lambda a, b: [int(hashlib.sha256(f"{x}\x1f{y}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF for x, y in zip(a, b)]


@register("equal")
def _equal() -> Scorer:
    return lambda a, b: [float(x == y) for x, y in zip(a, b)]


@register("words")
def _words() -> Scorer:
    """Jaccard similarity of the words, lower-cased; two texts without words are alike."""

    def score(a, b):
        sets = [(set(x.lower().split()), set(y.lower().split())) for x, y in zip(a, b)]
        return [len(x & y) / len(x | y) if x | y else 1.0 for x, y in sets]

    return score


@register("letters")
def _letters() -> Scorer:
    """Jaccard similarity of the runs of a-z, lower-cased; 0 for two texts without any."""
    import re

    def score(a, b):
        sets = [(set(re.findall("[a-z]+", x.lower())), set(re.findall("[a-z]+", y.lower()))) for x, y in zip(a, b)]
        return [len(x & y) / max(1, len(x | y)) for x, y in sets]

    return score


@register("trigrams")
def _trigrams() -> Scorer:
    """Cosine of character trigram counts."""
    from collections import Counter

    def grams(t: str) -> Counter:
        t = f"  {t.lower()} "
        return Counter(t[i : i + 3] for i in range(len(t) - 2))

    def score(a, b):
        out = []
        for x, y in zip(a, b):
            p, q = grams(x), grams(y)
            out.append(sum(n * q[g] for g, n in p.items()) / (sum(n * n for n in p.values()) * sum(n * n for n in q.values())) ** 0.5)
        return out

    return score


def _scored(name: str, factory: Callable[[], Scorer], batch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if name not in _built:
                _built[name] = factory()
            scorer = _built[name]
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                a, b = part["a"].tolist(), part["b"].tolist()
                errors: list[str | None] = [None] * len(a)
                try:
                    scores = [float(x) for x in scorer(a, b)]
                    if len(scores) != len(a):
                        raise ValueError(f"{len(scores)} scores for {len(a)} pairs")
                except Exception:  # which pair it is shows when each is tried alone
                    scores = []
                    for i, (x, y) in enumerate(zip(a, b)):
                        try:
                            (value,) = scorer([x], [y])
                            scores.append(float(value))
                        except Exception as e:  # noqa: BLE001  a failure is a row
                            scores.append(float("nan"))
                            errors[i] = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"a": a, "b": b, "score": scores, "error": errors})

    return run


def score_pairs(rows: DataFrame, a: str, b: str, scorer: str | Callable[[], Scorer], batch: int = 256) -> DataFrame:
    """``rows`` with ``score`` and ``error`` of their two texts; each distinct pair is scored once, in one task.

    ``scorer``: a registered name, or a factory. Null texts have neither score nor error. A score that is not a number is null.
    """
    name, factory = (scorer, factory_of(scorer)) if isinstance(scorer, str) else (f"{scorer.__module__}.{scorer.__qualname__}", scorer)
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct()
    told = pairs.mapInPandas(_scored(name, factory, batch), "a string, b string, score double, error string")
    told = told.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.when(~F.isnan("score"), F.col("score")).alias("score"), "error")
    return rows.join(told, (F.col(a).cast("string") == F.col("__a")) & (F.col(b).cast("string") == F.col("__b")), "left").drop("__a", "__b")
