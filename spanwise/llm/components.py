"""Connected components of links, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import cut_at, drop


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for each end of ``links`` (a, b: long); component is the least node reached.

    Each round hangs every node's larger neighbours, then all its smaller ones, on
    the least it knows of; a path of n nodes takes about log n rounds. Only minima
    are kept of a node's neighbours, so a node with very many costs no more memory.
    The links of each half of a round are written to the shared folder, which cuts
    the lineage and keeps every plan small. Links that are null or lead from a node
    to itself are ignored; without links the result is empty.
    """
    spark = links.sparkSession
    stars, path = cut_at(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "components")
    seen = None
    for _ in range(most_rounds):
        # the least neighbour that each node has; what is larger than the node hangs on it
        ways = stars.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
        large, half = cut_at(stars.join(least, F.col("v") == F.col("hub")).select("u", F.col("m").alias("v")).distinct(), "components")
        # each node and its smaller neighbours hang on the least of these
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u > v").distinct()
        # a task that is run again may count twice: then there is a round more, never one less
        told = Observation()
        after, new = cut_at(small.observe(told, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("decimal(20)")).alias("s")), "components")
        drop(spark, path)
        drop(spark, half)
        stars, path, now = after, new, tuple(told.get.values())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Union-find over 0..n-1 in numpy, for the links one task finds."""

    def __init__(self, n: int):
        import numpy as np

        self.np, self.parent = np, np.arange(n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def roots(self):
        """The root of every element."""
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                return p
            p = self.parent = q

    def link(self, a, b) -> None:
        """Link a[k] with b[k]; the smaller index becomes the root."""
        np = self.np
        while len(a):
            p = self.roots()
            a, b = p[a], p[b]
            open_ = a != b
            hi, lo = np.maximum(a, b)[open_], np.minimum(a, b)[open_]
            np.minimum.at(p, hi, lo)
            a, b = hi, lo
