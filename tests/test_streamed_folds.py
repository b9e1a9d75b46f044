"""Folds that read a group's rows in the stream of a task, against plain versions."""

import random

from pyspark.sql import functions as F

from spanwise.operators import matching, tracks
from spanwise.plans import registry


def plain_tracks(rows, most_gap):
    out = {}
    for rec in {r[0] for r in rows}:
        live, fresh = {}, 0
        for when in sorted({r[1] for r in rows if r[0] == rec}):
            boxes = [(r[2], r[3], r[4:]) for r in sorted(rows) if r[:2] == (rec, when)]
            live, fresh, told = tracks.associate(live, fresh, when, boxes, most_gap, 0.1, 0.2)
            out |= {(rec, when, b[0]): k for b, k in zip(boxes, told)}
    return out


def test_tracks_are_folded_once_in_a_stream(spark):
    rng = random.Random(3)
    rows, box = [], 0
    for rec in range(5):
        t = 0.0
        for _ in range(rng.choice([1, 3, 60, 90])):
            t += rng.choice([0.5, 1.0, 2.5, 3.0, 3.5, 20.0])
            for _ in range(rng.choice([1, 1, 2, 4])):
                x, y = rng.uniform(0, 40), rng.uniform(0, 10)
                rows.append((rec, t, box, rng.choice("ab"), x, y, x + 30, y + 30))
                box += 1
    rng.shuffle(rows)
    schema = "rec int, t double, box_id long, label string, x0 double, y0 double, x1 double, y1 double"
    odd = [(None, 1.0, 9001, "a", 0.0, 0.0, 9.0, 9.0), (1, None, 9002, "a", 0.0, 0.0, 9.0, 9.0), (1, float("nan"), 9003, "a", 0.0, 0.0, 9.0, 9.0)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames go across batches
    try:
        out = tracks.track(spark.createDataFrame(rows + odd, schema), "rec", "t", 3.0)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("InPandas") == 1
        got = {(r.rec, r.t, r.box_id): r.track for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == plain_tracks(rows, 3.0)
    assert tracks.track(spark.createDataFrame([], schema), "rec", "t", 3.0).count() == 0


def test_nearest_free_against_the_fold_over_arrays(spark):
    rng = random.Random(8)
    rows, at = [], 0
    for source in ("a", "b", None, "only left", "only right", "one score"):
        for _ in range(120):
            chooses = {"only left": True, "only right": False}.get(source, rng.random() < 0.55)
            score = 0.5 if source == "one score" else rng.choice([rng.randrange(12) / 7, rng.random(), 0.3, 0.1 + 0.2])
            rows += [(source, at, score, chooses)] * rng.choice([1, 1, 1, 2])
            at += 7 if rng.random() < 0.5 else 1
    rows += [("far", 9000 + k, s, False) for k, s in enumerate((3.0, 2.0, 1.0, 2.0))] + [("far", 9010, 1e300, True), ("far", 9011, -1e300, True), ("far", 9012, 2.0, True), ("far", 9013, 2.0, True), ("far", 9014, 2.0, True)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows + [("a", 99_999, None, False), ("a", 99_998, float("nan"), True)], "source string, id long, score double, chooses boolean")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = matching.nearest_free(frame, "source", "id", "score", "chooses")
        assert out._jdf.queryExecution().optimizedPlan().toString().count("InPandas") == 1
        got = sorted(map(tuple, out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    side = lambda c: F.array_sort(F.collect_list(F.when(F.col("chooses") == c, F.struct("id", "score"))))
    flip = lambda a: F.transform(a, lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id")))
    sides = frame.where("score < 1e301").groupBy("source").agg(side(True).alias("l"), side(False).alias("r"))
    want = sides.select("source", F.explode(matching.nearest_without_replacement(flip(F.col("l")), flip(F.col("r")))).alias("p")).select("source", "p.*")
    assert got == sorted(map(tuple, want.collect()), key=str) and len(got) > 150
    assert [r[2] for r in got if r[0] == "far"] == [9000, 9001, 9003, 9002]


def test_no_stratum_is_a_row_of_arrays(spark, tmp_path):
    docs = [(k, "", "en", f"src{k % 2}", 400 + k) for k in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k // 2 % 2, 0) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = registry.QUERIES["j21_nearest_without_replacement"](spark, str(tmp_path))
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() > 100
