"""Groups of linked items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled


def linked_groups(items: DataFrame, links: DataFrame, key: str, most_rounds: int = 100) -> DataFrame:
    """``key, root``: the least key that links (a, b) lead to, an item without links its own.

    Every round halves the way to the root: an item takes the least root among its
    own, its neighbours' and its root's. Rounds are checkpointed to the folder that
    ``spark.checkpoint.dir`` names.
    """
    both = settled(links.select(F.col("a").alias(key), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias(key), F.col("a").alias("other"))).distinct())
    label = settled(items.select(key, F.col(key).alias("root")))
    for _ in range(most_rounds):
        near = both.join(label.select(F.col(key).alias("other"), "root"), "other").groupBy(key).agg(F.min("root").alias("near"))
        jump = label.select(F.col(key).alias("root"), F.col("root").alias("jump"))
        after = settled(label.join(near, key, "left").join(jump, "root", "left").select(key, F.least("root", F.coalesce("near", "root"), F.coalesce("jump", "root")).alias("root")))
        changed = after.join(label.select(key, F.col("root").alias("was")), key).where("root <> was").limit(1).count()
        label = after
        if not changed:
            return label
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
