"""Cuts in the lineage, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read again.

    Without that setting a local session uses a temporary folder; on a cluster,
    whose machines share none, this is an error.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
