"""Texts as numpy arrays of code points: words and hashes without a loop over words."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C55
_tables: dict[str, np.ndarray] = {}
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of ``BASE`` modulo 2^64."""
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 256), BASE, np.uint64)
        step[0] = 1
        _powers = np.cumprod(step, dtype=np.uint64)
    return _powers[:n]


def letters() -> np.ndarray:
    """For each code point whether ``str.isalpha`` holds."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def kinds() -> np.ndarray:
    """A class for each code point: 1 upper case, 2 other letters, 3 digits, 4 white space; else 16 and the code point."""
    if "kinds" not in _tables:
        out = np.arange(0x110000, dtype=np.uint32) + 16
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                out[i] = 1 if c.isupper() else 2
            elif c.isdigit():
                out[i] = 3
            elif c.isspace():
                out[i] = 4
        _tables["kinds"] = out
    return _tables["kinds"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for each of ``x``."""
    x = x.astype(np.uint64)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and where each text starts (one more: the end)."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=starts[1:])
    return cp, starts


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the rows of these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for each run; runs are in order and do not overlap; ``values`` are mixed."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    offset = within(lengths)
    at = np.repeat(starts, lengths) + offset
    product = values[at] * powers(int(lengths.max()))[offset]
    first = np.cumsum(lengths) - lengths
    return mixed(np.add.reduceat(product, first))


def ngrams(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n`` values from each place of each run that has as many, and each one's run."""
    count = np.maximum(lengths - n + 1, 0)
    owner = np.repeat(np.arange(len(starts)), count)
    at = np.repeat(starts, count) + within(count)
    total = np.zeros(len(at), np.uint64)
    for k, p in enumerate(powers(n)):
        total += values[at + k] * p
    return mixed(total + np.uint64(n)), owner


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted ``table``, and which of them are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def per_text(word_starts: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """The index of the first word of each text, one more for the end."""
    return np.searchsorted(word_starts, text_starts)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows ``bounds[k]:bounds[k + 1]``; 0 for an empty one."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out
