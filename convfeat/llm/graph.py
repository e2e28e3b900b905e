"""Connected components of an edge table by alternating star steps, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    tied = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lower neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    lower = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return lower.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for each node of the edges (``a``, ``b``) but the roots, the least node of each component.

    A step never makes more edges than it read. Ends when every edge ties a node to its root.
    """
    now = written(edges.where("a <> b").distinct(), "edges")
    while True:
        after = written(_small_star(_large_star(now)), "edges")
        # done once each upper node has one edge and no lower node has an upper one
        many = after.groupBy("a").count().where("count > 1").select("a")
        chained = after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi")
        if many.unionByName(chained).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after
