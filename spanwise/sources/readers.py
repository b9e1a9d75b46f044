"""Readers of annotation files: wrapped JSON, JSONL, CSV with odd headers, XLSX, configs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# Keys under which a wrapper holds its rows.
WRAPPERS = ("events", "recordings", "data", "items", "segments", "predictions")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of whole-file JSON: a list, a wrapper of a list, or an object whose values are the rows."""
    files = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"array<{schema}>")
    wrapped = [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<{schema}>") for k in WRAPPERS]
    values = F.map_values(F.from_json("value", f"map<string,{schema}>"))
    is_list = F.ltrim("value").startswith("[")
    held = F.coalesce(*wrapped, values)
    return files.select(F.explode(F.when(is_list, whole).otherwise(held)).alias("row")).where("row IS NOT NULL").select("row.*")


def jsonl(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """JSON lines; with ``keys`` the last line of each key wins, by file and line."""
    rows = spark.read.schema(schema).json(path)
    if not keys:
        return rows
    placed = rows.withColumn("__at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return placed.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("__at").desc()))).where("__r = 1").drop("__r", "__at")


def csv_rows(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header, a byte-order mark or not; ``prefixes``: new name by the start of a column's name."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    names = []
    for c in rows.columns:
        bare = c.lstrip("﻿").strip()
        names.append(next((new for start, new in (prefixes or {}).items() if bare.startswith(start)), bare))
    return rows.toDF(*names)


def titled_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose first row may be a title: the header is the second row if the first has at most two filled cells."""
    head = spark.read.text(path).limit(2).collect()
    filled = [x for x in head[0][0].lstrip("﻿").split(",") if x.strip()] if head else []
    if len(head) < 2 or len(filled) > 2:
        return csv_rows(spark, path)
    names = [x.strip().strip('"') for x in head[1][0].split(",")]
    rows = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in names))
    first = names[0]
    title, header = head[0][0].split(",")[0].strip('"'), names[0]
    return rows.where(~F.col(first).isin(title, title.lstrip("﻿"), header) | F.col(first).isNull())


def config(spark: SparkSession, path: str, required: list[str] = ()) -> dict:
    """A JSON or YAML configuration; a missing block is an error, never a default."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if text.lstrip().startswith("{"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    missing = [k for k in required if k not in (found or {})]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return found


def column_number(ref: str) -> int:
    """0 for A, 25 for Z, 26 for AA, from a cell's reference."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """Cells of one sheet of an XLSX file; sparse rows are filled with null by their references."""
    import io
    import zipfile
    from xml.etree import ElementTree

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.findall("m:c", ns)):
                v, inline = c.find("m:v", ns), c.find("m:is", ns)
                text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else None if v is None else v.text
                if c.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                cells[column_number(c.get("r")) if c.get("r") else k] = text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").option("columns", "a,b").load(path)``: one task a file."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        return StructType([StructField(c.strip(), StringType()) for c in self.options["columns"].split(",")])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(schema, self.options)


class XlsxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.width, self.path, self.sheet = len(schema.fields), options["path"], int(options.get("sheet", "1"))

    def partitions(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            return [InputPartition(x.path) for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".xlsx")]
        return [InputPartition(path)]

    def read(self, partition):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with system.open_input_file(partition.value) as f:
            rows = sheet_rows(f.read(), self.sheet)
            next(rows, None)  # the header
            for r in rows:
                yield tuple((r + [None] * self.width)[: self.width])


def polymorphic_segments(raw: str) -> Column:
    """Segments of a JSON cell whichever way they are written: lists ``[label, start, end]`` or objects with either names."""
    as_lists = F.from_json(F.col(raw), "array<array<string>>")
    as_objects = F.from_json(F.col(raw), "array<struct<label:string,name:string,start:double,end:double,s:double,e:double>>")
    lists = F.transform(as_lists, lambda x: F.struct(x[0].alias("label"), x[1].try_cast("double").alias("start"), x[2].try_cast("double").alias("end")))
    objects = F.transform(as_objects, lambda x: F.struct(F.coalesce(x["label"], x["name"]).alias("label"), F.coalesce(x["start"], x["s"]).alias("start"), F.coalesce(x["end"], x["e"]).alias("end")))
    return F.when(F.col(raw).rlike(r"^\s*\[\s*\["), lists).otherwise(objects)



def resolved(spark: SparkSession, patterns: list[str], left_out: str = ".manifest.json") -> tuple[list[str], list[str]]:
    """Files that paths, folders (their ``*.json``) and globs name, each once and in order, and the patterns that match nothing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found, missing = [], []
    for pattern in patterns:
        at = path(pattern)
        system = at.getFileSystem(conf)
        hits = list(system.globStatus(at) or [])
        if len(hits) == 1 and hits[0].isDirectory():
            hits = list(system.globStatus(path(at, "*.json")) or [])
        names = sorted(h.getPath().toString() for h in hits if not h.isDirectory())
        if not names:
            missing.append(pattern)
        found += [n for n in names if not n.endswith(left_out) and n not in found]
    return found, missing


def feature_caches(spark: SparkSession, paths: list[str], key: str = "recording_id") -> DataFrame:
    """Rows of several Parquet caches (vectors as array columns); of a recording in several the later path wins, whole."""
    out = None
    for k, path in enumerate(paths):
        one = spark.read.parquet(path).withColumn("__at", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    last = F.max("__at").over(W.partitionBy(key))
    return out.withColumn("__last", last).where("__at = __last").drop("__at", "__last")


REFERENCE = "recording_id string, segments array<struct<task_label:string,recording_relative_start_s:double,recording_relative_end_s:double,brief_description:string,boundary_reason:struct<start:string,`end`:string>>>"
RECORDING = "recording_id string, segments array<struct<label_en:string,start_s:double,end_s:double>>"


def reference_segments(spark: SparkSession, folder: str, durations: DataFrame | None = None) -> DataFrame:
    """``recording_id, video, duration, segments, reasons`` of ``segmentation_reference/*.segments.json``; those without segments are left out.

    A reason joins those of a segment's two ends, else it is the brief description.
    The duration is that of ``durations`` (recording_id, duration), else the last end.
    """
    rows = spark.read.schema(REFERENCE).json(f"{folder}/segmentation_reference/*.segments.json", multiLine=True).where("size(segments) > 0")
    segs = F.transform("segments", lambda s: F.struct(s["task_label"].alias("label"), s["recording_relative_start_s"].alias("start"), s["recording_relative_end_s"].alias("end")))
    reason = F.transform("segments", lambda s: F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(s["boundary_reason"]["start"], F.lit("")), F.nullif(s["boundary_reason"]["end"], F.lit(""))), F.lit("")), s["brief_description"], F.lit("")))
    out = rows.select("recording_id", F.concat(F.lit(f"{folder}/raw_videos/"), "recording_id", F.lit(".mp4")).alias("video"), F.array_max(F.transform("segments", lambda s: s["recording_relative_end_s"])).alias("duration"), segs.alias("segments"), reason.alias("reasons"))
    if durations is not None:
        known = durations.select("recording_id", F.col("duration").alias("__d"))
        out = out.join(known, "recording_id", "left").withColumn("duration", F.coalesce("__d", "duration")).drop("__d")
    return out.withColumn("duration", F.round("duration", 3))


def recording_folders(spark: SparkSession, root: str) -> DataFrame:
    """``recording_id, video, duration, segments`` of ``recordings/*/segments.json``; a missing id is the folder's name."""
    rows = spark.read.schema(RECORDING).json(f"{root}/recordings/*/segments.json", multiLine=True).withColumn("__file", F.input_file_name()).where("size(segments) > 0")
    folder = F.regexp_replace("__file", "/[^/]*$", "")
    segs = F.transform("segments", lambda s: F.struct(s["label_en"].alias("label"), s["start_s"].alias("start"), s["end_s"].alias("end")))
    return rows.select(F.coalesce("recording_id", F.element_at(F.split(folder, "/"), -1)).alias("recording_id"), F.concat(folder, F.lit("/mid.mp4")).alias("video"), F.array_max(F.transform("segments", lambda s: s["end_s"])).alias("duration"), segs.alias("segments"))
