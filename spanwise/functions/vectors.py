"""Column expressions on vectors held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def pair_block(a: Column, b: Column) -> Column:
    """Both vectors, their absolute difference and their product, one after another."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def block(a: Column, size: int, k: int) -> Column:
    """The k-th of a vector's blocks of ``size`` components."""
    return F.slice(a, k * size + 1, size)


def linear(x: Column, weights: list[float], bias: float) -> Column:
    return dot(x, F.array(*[F.lit(float(w)) for w in weights])) + bias


def without_blocks(v: Column, blocks: dict[str, tuple[int, int]], dropped: list[str]) -> Column:
    """A vector without the named column blocks (from, to); an unknown name is an error."""
    if set(dropped) - set(blocks):
        raise ValueError(f"unknown blocks: {sorted(set(dropped) - set(blocks))}")
    return F.concat(*[F.slice(v, a + 1, b - a) for name, (a, b) in blocks.items() if name not in dropped])
