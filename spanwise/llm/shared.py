"""Folders that driver and executors share, and cuts in the lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent a local session uses one temporary folder per
    application in its place; on a cluster, whose machines do not share one, this
    is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def row_key() -> Column:
    """What tells a row of documents from others with its ``doc_id``, or with none."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that :func:`cut` writes inside are deleted at the end, but those marked ``keep``: nothing after it may read them."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop(spark, path)


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    A lost executor then costs a re-read, never the work before the cut.
    """
    out, path = cut_at(df, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return out


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`cut`, with the path, for a later :func:`drop`."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`cut_at` wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def sent(spark: SparkSession, value):
    """``value`` broadcast for the actions inside, and gone from driver and executors after them."""
    held = spark.sparkContext.broadcast(value)
    try:
        yield held
    finally:
        held.destroy()


def tidy() -> None:
    """Give memory that a Python process has freed back to the system; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
