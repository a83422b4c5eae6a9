"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected edges (u, v), where component is the smallest node reachable.

    Loops and repeated edges count for nothing; edges with a null end are dropped; no edges give no rows. Nodes are of one
    type that can be ordered. Each round is cut off with a checkpoint in the shared folder. Only minima per node are ever
    gathered, and they are written before they are joined, so that Spark can split the join where a hub has many edges.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        inner = now.join(now.select(F.col("u").alias("v")), "v", "left_semi")
        if inner.isEmpty() and now.groupBy("u").count().where("count > 1").isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
