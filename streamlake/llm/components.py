"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlake.llm.common import keep_table


def _least_neighbours(pairs: DataFrame) -> DataFrame:
    """``u, least``: the smaller of ``u`` and its least neighbour. A minimum, combined map-side, so
    that a node with a large share of the edges is one row per task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("at"), F.least("u", "m").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on its least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least_neighbours(both), F.col("u") == F.col("at"))
            .where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
            .distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = _least_neighbours(down)
    joined = down.join(least, F.col("u") == F.col("at"))
    return (joined.where(F.col("v") != F.col("least"))
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .union(least.select(F.col("at").alias("u"), F.col("least").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (u, v)``; a component is named after its least
    node. Self-loops and repeated edges are harmless, edges with a null end are left out, no edge
    gives no row.

    Alternating large and small stars, each a minimum and a join; the graph ends as stars around the
    least nodes, after a logarithmic number of rounds or so. Each round is written below the shared
    folder, and what decides on the end is a count and a checksum of its edges.
    """
    graph = keep_table(edges.select("u", "v").where("u != v").distinct(), "components")
    seen = None
    while True:
        graph = keep_table(_small_star(_large_star(graph)), "components")
        state = graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    tops = graph.select(F.col("v").alias("node")).distinct()
    return graph.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        tops.select("node", F.col("node").alias("component")))
