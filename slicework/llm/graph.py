"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicework.llm.shared import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them; a node with many neighbours is a join key, not a group."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = edges.unionByName(back) if large else edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = near.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src"), F.least("src", "low").alias("low"))
    linked = near.join(low, "src")
    if large:
        out = linked.where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = linked.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))
    return out.where("src <> dst").distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that show that the links aren't yet stars around roots: with two targets, or both source and target."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
    sums = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into"))
    return sums.where("out > 1 or (out > 0 and into > 0)")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Of ``edges`` (``src``, ``dst``: any ordered type), each node and its ``component``, the smallest node reached.

    Rounds are written to the shared folder, so lineage stays short. Self-links give no rows: nodes without a
    link to another node are absent.
    """
    edges = materialize(edges.where("src <> dst").select("src", "dst"), "edges")
    for _ in range(most_rounds):
        edges = materialize(_star(_star(edges, True), False), "edges")
        if not _unsettled(edges).take(1):
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
