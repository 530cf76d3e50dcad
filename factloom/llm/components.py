"""Connected components by alternating large and small stars, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, new_path, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Each step joins nodes to the least of their neighbours; nodes with many
    neighbours are reduced within tasks first, and their edges are dealt by a join
    that can be split.  The number of steps follows the logarithm of the longest path.
    """
    spark, left = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        """A step's table; the one two before it, which nothing reads any more, goes."""
        left.append(new_path(spark, "stars"))
        out = written(df, "stars", left[-1])
        if len(left) > 2:
            dropped(spark, left.pop(0))
        return out

    now = kept(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the least neighbour
        large = kept(both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        moved = large.join(least, F.col("a") == F.col("n"))
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
        now = kept(small.filter("a != b").distinct())
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
