"""Connected components of an edge table, by alternating large and small stars.

Each round rewires every edge towards the smallest node its end has seen, so paths shrink by half or
more and the number of rounds is logarithmic.  Joins are on a node with its minimum, one row per
node, so a hub with a third of all edges is an ordinary skewed join side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node are linked to the least of its neighbourhood.  Small: a node
    and its neighbours below it are."""
    pairs = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        moved = joined.select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).select("a", "b")
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest node."""
    ordered = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current, last = work.keep(ordered.distinct()), None
    while True:
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == last:
            break
        last = state
        current = work.keep(_star(_star(current, True), False))
    leaves = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return work.keep(leaves.unionByName(leaves.select(F.col("component").alias("node"), "component")).distinct())
