"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.llm.shared import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v; every edge is linked to the least neighbour of its centre."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = near.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` for every node of the edges (a, b); the component is its least node.

    The number of rounds grows with the logarithm of the longest chain; each round reads the written edges of the
    one before.  Self loops and repeated edges have no effect; an empty edge table gives an empty result.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before, rounds = scratch.table(current, f"{name}-0"), None, 0
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, rounds = state, rounds + 1
        stepped = scratch.table(_star(_star(current, large=True), large=False), f"{name}-{rounds}")
        scratch.drop(f"{name}-{rounds - 1}")
        current = stepped
