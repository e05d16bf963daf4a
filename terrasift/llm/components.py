"""Connected components of a distributed edge table by contraction; nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node that can be reached.

    Each round hangs every node below its smallest neighbour, follows those parents to their roots and contracts the
    edges, so each tree becomes one node and the rounds grow with the logarithm of the largest component. Hubs are
    pre-aggregated by min() before they are shuffled.
    """
    edges = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    result = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = scratch.table(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        )
        while True:
            above = parents.select(F.col("node").alias("up"), F.col("up").alias("root"))
            jumped = scratch.table(parents.join(above, "up").select("node", "root", (F.col("root") != F.col("up")).alias("moved")))
            parents = jumped.select("node", F.col("root").alias("up"))
            if jumped.where("moved").isEmpty():
                break
        if result is None:
            result = parents.select("node", F.col("up").alias("component"))
        else:
            result = scratch.table(
                result.join(parents.withColumnRenamed("node", "component"), "component", "left").select(
                    "node", F.coalesce("up", "component").alias("component")
                )
            )
        roots = parents.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        edges = edges.join(roots, "a").select("ra", "b").join(roots.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        edges = scratch.table(edges.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if result is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return result
