"""Digests of tables: fingerprints of id sets, and contents that no order or partitioning changes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends each id in a fingerprint, and the hexadecimal digits kept.
MARK, DIGITS = "\x1f", 16


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, running, names, prints = None, None, [], []
    for batch in batches:
        for at, ids in zip(*(batch.column(c).to_pylist() for c in range(2))):
            if running is None or at != group:
                if running is not None:
                    names.append(group)
                    prints.append(running.hexdigest()[:DIGITS])
                group, running = at, hashlib.sha256()
            running.update((ids + MARK).encode())
    if running is not None:
        names.append(group)
        prints.append(running.hexdigest()[:DIGITS])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(prints, pa.string())], names=["group", "fingerprint"])


def fingerprints(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``group, fingerprint``: the SHA-256 over each group's distinct ids as text, sorted, each with its end mark.

    The hash runs along the sorted rows of a task, which Spark sorts with spill: no row
    and no task holds a group's ids.
    """
    kind = dict(rows.dtypes)[group]
    ids = rows.where(F.col(key).isNotNull()).select(F.col(group).cast("string").alias("group"), F.col(key).cast("string").alias("key")).distinct()
    told = ids.repartition("group").sortWithinPartitions("group", "key").mapInArrow(_fingerprinted, "group string, fingerprint string")
    return told.select(F.col("group").cast(kind).alias(group), "fingerprint")


def _bits(seed: int, *columns: Column) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def content_digest(table: DataFrame) -> str:
    """A digest of a table's rows that their order and partitioning do not change, but any value, row, copy of a row or column does.

    Two 64-bit hashes of each row, nulls told from values, are summed without loss; the
    sums, the number of rows and the columns' names and kinds are hashed. One pass, one row to the driver.
    """
    columns = sorted(table.columns)
    kinds = dict(table.dtypes)
    # the hash of a null leaves the seed unchanged: say of each value whether it is there
    parts = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if "map<" in kinds[c] or kinds[c] == "variant" else F.col(f"`{c}`"))]
    sums = [F.sum(_bits(seed, *parts).cast("decimal(38,0)")) for seed in (11, 29)]
    told = table.agg(F.count(F.lit(1)), *sums).first()
    text = "|".join([*(f"{c}:{kinds[c]}" for c in columns), str(told[0]), str(told[1]), str(told[2])])
    return hashlib.sha256(text.encode()).hexdigest()
