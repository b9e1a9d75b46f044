"""Median and MAD of a stream: a mergeable quantile sketch for each group and window, merged when asked.

A window's state is one sketch, however many events it has; closed windows are a small
table, and any set of them merges into a baseline. Spark keeps the sketches (KLL) in
its own aggregates, so nothing runs in Python. A sketch of size ``k`` is wrong by less
than ``rank_error(k)`` in rank; the MAD, which is told from quantiles of the merged
sketch, by less than twice as much and ``1 / POINTS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, quantiles that a MAD is told from, and the factor that makes a MAD a spread.
SIZE, POINTS, SPREAD = 1024, 512, 1.4826


def rank_error(k: int = SIZE) -> float:
    """The error in rank (as a share of all) that a sketch of size ``k`` stays below, 99 times in 100."""
    return 2.296 / k**0.9021


def window_sketches(events: DataFrame, key: str, value: str, ts: str = "ts", width: str = "1 day", late: str = "2 days", k: int = SIZE) -> DataFrame:
    """``key, start, n, sketch`` of each window, of a stream or of a table; values that are null or no number are left out."""
    some = events.withWatermark(ts, late).where(F.col(value).isNotNull() & ~F.isnan(value))
    closed = some.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))
    return closed.select(key, F.col("w.start").alias("start"), "n", "sketch")


def baseline(sketches: DataFrame, key: str, k: int = SIZE) -> DataFrame:
    """``key, n, median, mad`` (the MAD times 1.4826) of all windows in ``sketches``."""
    merged = sketches.groupBy(key).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("__s"))
    ranks = F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)])
    told = merged.select(key, "n", F.kll_sketch_get_quantile_double("__s", F.lit(0.5)).alias("median"), F.kll_sketch_get_quantile_double("__s", ranks).alias("__q"))
    away = F.array_sort(F.transform("__q", lambda q: F.abs(q - F.col("median"))))
    return told.select(key, "n", "median", (F.element_at(away, POINTS // 2) * SPREAD).alias("mad"))
