"""Plans for large tables: what is not to be sent to the driver is not."""

from pyspark.sql import functions as F

from spanwise.operators import resample


def test_draws_of_many_recordings_are_not_broadcast(spark):
    names = spark.range(900_000).select((F.col("id") * 7).alias("rec"))
    plan = resample.draws(names, "rec", 100)._jdf.queryExecution().executedPlan().toString()
    assert "HashedRelationBroadcastMode" not in plan and "SortMergeJoin" in plan


def test_draws_are_as_many_as_recordings(spark):
    got = resample.draws(spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "rec string"), "rec", 50).collect()
    assert {r.rec for r in got} == {None, "a", "b"} and sorted(b for r in got for b in r.drawn) == sorted(3 * list(range(50)))


def test_curves_do_not_depend_on_the_width_of_the_replicates_numbers(spark):
    rows = spark.createDataFrame([(k % 13, k * 37 % 11 / 10, k * 7 % 3 % 2) for k in range(200)], "rec int, s double, y int")
    few = {r.b: (round(r.auroc, 9), round(r.pr_auc, 9)) for r in resample.bootstrap_curves(rows, "rec", "s", "y", 128).collect()}
    many = {r.b: (round(r.auroc, 9), round(r.pr_auc, 9)) for r in resample.bootstrap_curves(rows, "rec", "s", "y", 300).collect()}
    assert len(few) == 129 and len(many) == 301 and few == {b: many[b] for b in few}
