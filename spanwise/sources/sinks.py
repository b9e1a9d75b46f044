"""Sinks: resumable appends, shards, blind and hidden projections, manifests, frozen models."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import settled
from ..operators.digests import content_digest
from ..operators.ordering import numbered


def pending(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not in the output yet."""
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def append_pending(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows that ``path`` lacks; how many they were. A rerun adds nothing."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    todo = pending(rows, done, key)
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    return n


def write_rows(rows: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """Rows as ``jsonl`` (a line each), ``json`` (an array a file, if there is any partition), ``csv`` (header, nested columns as JSON) or ``parquet``, a file a partition."""
    if kind == "csv":
        nested = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        rows.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).csv(path, header=True, escape='"')
    elif kind == "json":
        # one array a partition; JSON text has no line feeds of its own
        parts = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInPandas(_as_arrays, "value string")
        parts.write.mode(mode).text(path)
    elif kind == "jsonl":
        rows.write.mode(mode).json(path, ignoreNullFields=False)
    elif kind == "parquet":
        rows.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown kind of sink: {kind}")


def _as_arrays(batches):
    """The partition's lines as one JSON array over as many lines."""
    import pandas as pd

    first = True
    for pdf in batches:
        lines = [("[" if first and i == 0 else ",") + v for i, v in enumerate(pdf["value"])]
        first = first and not lines
        yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def append_in_steps(rows: DataFrame, path: str, key: str, step: int) -> int:
    """Append what ``path`` lacks, ``step`` recordings (keys) at a time; how many appends there were. What is written stays if a later one fails."""
    spark = rows.sparkSession
    try:
        rows = pending(rows, spark.read.parquet(path), key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    placed = numbered(rows.select(key).distinct(), key).withColumn("__step", F.floor(F.col("place") / step)).drop("place")
    todo = settled(rows.join(placed, key))
    steps = todo.agg(F.max("__step")).first()[0]
    if steps is None:
        return 0
    for k in range(steps + 1):
        todo.where(F.col("__step") == k).drop("__step").write.mode("append").parquet(path)
    return steps + 1


def shard(rows: DataFrame, key: str, i: int, n: int) -> DataFrame:
    """Every n-th key in order, from the i-th."""
    keys = numbered(rows.select(key).distinct(), key).where(F.col("place") % n == i).select(key)
    return rows.join(keys, key, "left_semi")


def dual(rows: DataFrame, shown: list[str], hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """The reviewer's sheet and the key to it; a column on both sides but the first is an error."""
    both = set(shown[1:]) & set(hidden)
    if both:
        raise ValueError(f"shown and hidden: {sorted(both)}")
    return rows.select(*shown), rows.select(shown[0], *hidden)


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, base, sha`` of input files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("base"), F.substring(F.sha2("content", 256), 1, 16).alias("sha"))


def incomparable(manifests: DataFrame) -> DataFrame:
    """Base names that runs (run, base, sha) read in different versions."""
    return manifests.groupBy("base").agg(F.count_distinct("sha").alias("versions")).where("versions > 1")


def replay(argv: list[str], dropped: dict[str, int]) -> list[str]:
    """A command line without the given flags and as many values each as stated."""
    out, skip = [], 0
    for a in argv:
        if skip:
            skip -= 1
        elif a.split("=")[0] in dropped:
            skip = 0 if "=" in a else dropped[a]
        else:
            out.append(a)
    return out


def guarded(text: str, names: list[str]) -> str:
    """The text, unless it holds the value of one of these environment variables."""
    for n in names:
        value = os.environ.get(n)
        if value and value in text:
            raise ValueError(f"the output holds the value of {n}")
    return text


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """A frozen model as one row of JSON in Parquet."""
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(path).first()["model"])


def freeze(spark: SparkSession, path: str, scorers: dict[str, dict], inputs: dict[str, DataFrame], fitted: DataFrame, key: str) -> None:
    """Scorers by name, the content digests of the tables they were fitted from, and the keys of the fit set.

    The keys are a table of their own beside the model: they grow with the fit.
    """
    fitted.select(key).distinct().write.mode("overwrite").parquet(f"{path}/fitted")
    save_model(spark, {"scorers": scorers, "key": key, "inputs": {n: content_digest(t) for n, t in inputs.items()}}, f"{path}/model")


def thaw(spark: SparkSession, path: str, wanted: list[str], inputs: dict[str, DataFrame], rows: DataFrame, allow_in_sample: bool = False) -> tuple[dict[str, dict], DataFrame]:
    """The wanted scorers of a frozen model, and ``rows`` with ``in_sample``: whether a row's key was in the fit set.

    Raises where a table differs in content from that of the fit or is not given, where
    the model has no such scorer, and where rows are in the fit set without
    ``allow_in_sample``. The order and the partitioning of tables do not matter.
    """
    model = load_model(spark, f"{path}/model")
    for name, digest in model["inputs"].items():
        if name not in inputs:
            raise ValueError(f"the table {name} was used in the fit and is not given")
        if content_digest(inputs[name]) != digest:
            raise ValueError(f"the table {name} has changed since the fit")
    missing = [n for n in wanted if n not in model["scorers"]]
    if missing:
        raise ValueError(f"the model has no scorer for {missing}")
    key = model["key"]
    seen = spark.read.parquet(f"{path}/fitted").select(F.col(key).alias("__key"), F.lit(True).alias("__seen"))
    marked = rows.join(seen, rows[key].eqNullSafe(F.col("__key")), "left").withColumn("in_sample", F.coalesce("__seen", F.lit(False))).drop("__key", "__seen")
    if not allow_in_sample and not marked.where("in_sample").isEmpty():
        raise ValueError("some rows were in the set the model is fitted on")
    return {n: model["scorers"][n] for n in wanted}, marked


def assert_not_fitted(rows: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    """Rows to be scored, unless one of them was in the fit."""
    if not rows.join(fitted.select(key), key, "left_semi").isEmpty():
        raise ValueError("some rows were in the set the model is fitted on")
    return rows
