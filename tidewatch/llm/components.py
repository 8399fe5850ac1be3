"""Distributed union-find: connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node of its component.

    `edges` has the columns a and b; loops, repeats and both directions are allowed, rows
    with a null are ignored. Large-star and small-star steps alternate until only
    stars are left, each node under its root, which takes a number of steps that grows with the logarithm of the
    nodes. A node's least neighbour is an aggregate and is written before it is joined
    back, so a node with very many neighbours is split over tasks.
    """
    edges = cut_lineage(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Done when no node has a lesser neighbour and a greater or another one: all are stars.
        sides = edges.select(F.col("u").alias("node"), "v").unionByName(
            edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
        if sides.groupBy("node").agg(
                F.min("v").alias("lo"), F.max("v").alias("hi"),
                F.max(F.col("v").isNull()).alias("under")) \
                .filter("lo < hi OR lo IS NOT NULL AND under").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut_lineage(both.join(least, "u").filter("v > u")
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        edges = cut_lineage(
            large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
