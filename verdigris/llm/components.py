"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a"))))
    return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    near = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    ends = F.explode(F.array("a", "b"))
    return near.select(ends.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): root is the smallest node of the component; roots themselves are left out.

    Self loops, repeated edges and either direction are fine; null ends are ignored; no edges give no rows. Each round
    is written to the checkpoint folder, so a lost executor repeats one round only.
    """
    now = cut(edges.select(F.greatest(left, right).cast("long").alias("a"), F.least(left, right).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    state = None
    while True:
        now = cut(_small_star(_large_star(now)))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)
