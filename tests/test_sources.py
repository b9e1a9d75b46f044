import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spanwise.sources import readers, sinks


def test_json_wrappers(spark, tmp_path):
    schema = "struct<id:int,x:string>"
    rows = [{"id": 1, "x": "a"}, {"id": 2, "x": "b"}]
    for k, body in enumerate((rows, {"events": rows}, {"segments": rows}, {"p": rows[0], "q": rows[1]})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(body, indent=1))
        assert sorted(tuple(r) for r in readers.json_rows(spark, str(path), schema).collect()) == [(1, "a"), (2, "b")]


def test_jsonl_last_line_wins(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1, "x": "old"}\n\n{"id": 2, "x": "b"}\n{"id": 1, "x": "new"}\n')
    got = readers.jsonl(spark, str(path), "id int, x string", ["id"]).where("id IS NOT NULL").collect()
    assert sorted(tuple(r) for r in got) == [(1, "new"), (2, "b")]


def test_csv_with_mark_and_prefix(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿event_id,your_call(sharp|same|cannot)\ne1,sharp\n", encoding="utf-8")
    got = readers.csv_rows(spark, str(path), {"your_call": "call"})
    assert got.columns == ["event_id", "call"] and [tuple(r) for r in got.collect()] == [("e1", "sharp")]


def test_csv_with_title(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Audit sheet,,\nid,a,b\n1,x,y\n2,z,w\n")
    assert [tuple(r) for r in readers.titled_csv(spark, str(path)).orderBy("id").collect()] == [("1", "x", "y"), ("2", "z", "w")]


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>in</t></is></c><c r="C2"><v>3.5</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    assert list(readers.sheet_rows(workbook())) == [["head", "1"], ["in", None, "3.5"]]
    assert [readers.column_number(r) for r in ("A1", "Z9", "AA3", "BC12")] == [0, 25, 26, 54]
    path = tmp_path / "a.xlsx"
    path.write_bytes(workbook())
    spark.dataSource.register(readers.XlsxSource)
    got = spark.read.format("xlsx").option("columns", "a,b,c").load(str(path)).collect()
    assert [tuple(r) for r in got] == [("in", None, "3.5")]


def test_config_fails_closed(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"rules": [1]}')
    assert readers.config(spark, str(path), ["rules"]) == {"rules": [1]}
    with pytest.raises(ValueError):
        readers.config(spark, str(path), ["observability"])


def test_polymorphic_segments(spark):
    rows = [('[["cut", 0.5, 2]]',), ('[{"label": "cut", "start": 0.5, "end": 2}]',), ('[{"name": "cut", "s": 0.5, "e": 2}]',)]
    got = spark.createDataFrame(rows, "raw string").select(readers.polymorphic_segments("raw").alias("s")).collect()
    assert all([tuple(x) for x in r.s] == [("cut", 0.5, 2.0)] for r in got)


def test_resumable_append_and_shards(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "k")
    path = str(tmp_path / "out")
    assert sinks.append_pending(rows.where("k < 6"), path, "k") == 6
    assert sinks.append_pending(rows, path, "k") == 4
    assert sinks.append_pending(rows, path, "k") == 0
    parts = [{r.k for r in sinks.shard(rows, "k", i, 3).collect()} for i in range(3)]
    assert set.union(*parts) == set(range(10)) and sum(map(len, parts)) == 10


def test_blind_sheet_has_no_scores(spark):
    rows = spark.createDataFrame([(1, "t", 0.5)], "id int, text string, score double")
    shown, hidden = sinks.dual(rows, ["id", "text"], ["score"])
    assert shown.columns == ["id", "text"] and hidden.columns == ["id", "score"]
    with pytest.raises(ValueError):
        sinks.dual(rows, ["id", "score"], ["score"])


def test_manifests(spark, tmp_path, monkeypatch):
    for run, text in (("a", "x"), ("b", "y")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "in.csv").write_text(text)
        (tmp_path / run / "same.csv").write_text("s")
    hashes = sinks.file_hashes(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert [r.base for r in sinks.incomparable(hashes).collect()] == ["in.csv"]
    assert sinks.replay(["run", "--out", "x", "--k=3", "--v", "y"], {"--out": 1, "--k": 1}) == ["run", "--v", "y"]
    monkeypatch.setenv("SOME_TOKEN", "s3cret")
    with pytest.raises(ValueError):
        sinks.guarded("has s3cret inside", ["SOME_TOKEN"])
    sinks.save_model(spark, {"w": [1, 2.5]}, str(tmp_path / "m"))
    assert sinks.load_model(spark, str(tmp_path / "m")) == {"w": [1, 2.5]}
    with pytest.raises(ValueError):
        sinks.assert_not_fitted(spark.range(3), spark.range(1), "id")
    assert sinks.assert_not_fitted(spark.range(3), spark.range(5, 6), "id").select(F.count("id")).first()[0] == 3


def test_paths_are_resolved_and_misses_told(spark, tmp_path):
    for name in ("a.json", "b.json", "b.manifest.json", "sub/c.json", "sub/c.manifest.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    found, missing = readers.resolved(spark, [f"{tmp_path}/a.json", f"{tmp_path}/*.json", f"{tmp_path}/sub", f"{tmp_path}/none*.json"])
    assert [f.split("/")[-1] for f in found] == ["a.json", "b.json", "c.json"] and missing == [f"{tmp_path}/none*.json"]


def test_later_caches_win_whole(spark, tmp_path):
    schema = "recording_id string, t double, feats array<double>"
    spark.createDataFrame([("r1", 0.0, [1.0]), ("r1", 1.0, [1.0]), ("r2", 0.0, [2.0])], schema).write.parquet(f"{tmp_path}/train")
    spark.createDataFrame([("r1", 0.0, [9.0])], schema).write.parquet(f"{tmp_path}/val")
    got = readers.feature_caches(spark, [f"{tmp_path}/train", f"{tmp_path}/val"]).collect()
    assert sorted((r.recording_id, r.t, r.feats[0]) for r in got) == [("r1", 0.0, 9.0), ("r2", 0.0, 2.0)]


def test_annotation_folders(spark, tmp_path):
    ref = tmp_path / "segmentation_reference"
    ref.mkdir()
    segs = [{"task_label": "cut", "recording_relative_start_s": 1, "recording_relative_end_s": 2.5, "boundary_reason": {"start": "hand in", "end": "hand out"}}, {"task_label": "peel", "recording_relative_start_s": 2.5, "recording_relative_end_s": 7.12345, "brief_description": "peeling", "boundary_reason": None}]
    (ref / "r1.segments.json").write_text(json.dumps({"recording_id": "r1", "segments": segs}, indent=1))
    (ref / "r2.segments.json").write_text(json.dumps({"recording_id": "r2", "segments": []}))
    (r,) = readers.reference_segments(spark, str(tmp_path)).collect()
    assert (r.recording_id, r.duration, r.reasons) == ("r1", 7.123, ["hand in hand out", "peeling"]) and [tuple(s) for s in r.segments] == [("cut", 1.0, 2.5), ("peel", 2.5, 7.12345)]
    known = spark.createDataFrame([("r1", 9.0)], "recording_id string, duration double")
    assert readers.reference_segments(spark, str(tmp_path), known).first().duration == 9.0
    for name, body in (("x1", {"recording_id": "named", "segments": [{"label_en": "a", "start_s": 0, "end_s": 4}]}), ("x2", {"segments": [{"label_en": "b", "start_s": 1, "end_s": 3}]}), ("x3", {"segments": []})):
        (tmp_path / "recordings" / name).mkdir(parents=True)
        (tmp_path / "recordings" / name / "segments.json").write_text(json.dumps(body))
    got = {r.recording_id: (r.duration, r.video.split("/")[-2:]) for r in readers.recording_folders(spark, str(tmp_path)).collect()}
    assert got == {"named": (4.0, ["x1", "mid.mp4"]), "x2": (3.0, ["x2", "mid.mp4"])}


def test_sinks_of_every_kind(spark, tmp_path):
    rows = [(1, 'a "b", c', [1.5, 2.0]), (2, None, []), (3, "é", None)]
    df = spark.createDataFrame(rows, "id int, x string, v array<double>").repartition(2)
    for kind in ("jsonl", "json", "csv", "parquet"):
        sinks.write_rows(df, f"{tmp_path}/{kind}", kind)
    assert sorted(tuple(r) for r in spark.read.schema(df.schema).json(f"{tmp_path}/jsonl").collect()) == rows
    held = [x for f in (tmp_path / "json").glob("part-*") for x in json.loads(f.read_text())]
    assert sorted((x["id"], x["x"], x["v"]) for x in held) == rows
    back = readers.csv_rows(spark, f"{tmp_path}/csv").collect()
    assert sorted((int(r.id), r.x, json.loads(r.v) if r.v else None) for r in back) == rows
    sinks.write_rows(df.limit(0), f"{tmp_path}/none", "json")
    assert all(f.read_text().strip() in ("", "[]") for f in (tmp_path / "none").glob("part-*"))
    with pytest.raises(ValueError):
        sinks.write_rows(df, f"{tmp_path}/odd", "odd")


def test_appends_in_steps_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i // 3:02d}", i) for i in range(30)], "rec string, i int")
    assert sinks.append_in_steps(rows.where("rec < 'r04'"), f"{tmp_path}/out", "rec", 3) == 2
    assert sinks.append_in_steps(rows, f"{tmp_path}/out", "rec", 3) == 2
    assert sinks.append_in_steps(rows, f"{tmp_path}/out", "rec", 3) == 0
    assert sorted(r.i for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(30))
    assert [r.rec for r in sinks.shard(rows, "rec", 1, 4).select("rec").distinct().orderBy("rec").collect()] == ["r01", "r05", "r09"]
