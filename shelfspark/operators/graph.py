"""Breadth-first reach over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import checkpoint_root


def reach(
    edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int = 0
) -> DataFrame:
    """(node, depth) of everything within ``max_depth`` steps of the seeds.

    ``edges`` (src, dst) and ``seeds`` (node). Each level joins only the new
    nodes with the edges, drops known nodes and is checkpointed, so lineage and
    work stay per level. ``max_nodes`` stops the walk, lowest nodes first.
    """
    checkpoint_root(edges.sparkSession)
    edges = edges.select("src", "dst").distinct().checkpoint()
    frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    frontier = frontier.checkpoint()
    visited, seen = frontier, frontier.count()
    for depth in range(1, max_depth + 1):
        known = frontier.select(F.col("node").alias("src"))
        found = edges.join(known, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        found = found.join(visited.select("node"), "node", "left_anti")
        if max_nodes > 0:
            found = found.orderBy("node").limit(max(0, max_nodes - seen))
        frontier = found.withColumn("depth", F.lit(depth).cast("bigint")).checkpoint()
        fresh = frontier.count()
        if fresh == 0:
            break
        seen += fresh
        visited = visited.unionByName(frontier)
    return visited


def shared_target_edges(links: DataFrame, source: str, target: str) -> DataFrame:
    """Edges source <-> target as one two-sided graph.

    Sources that share a target are two steps apart; no source pairs are built,
    so a target named by a third of all sources costs one row per mention.
    """
    s = F.concat(F.lit("s:"), F.col(source).cast("string"))
    t = F.concat(F.lit("t:"), F.col(target).cast("string"))
    return links.select(s.alias("src"), t.alias("dst")).unionByName(
        links.select(t.alias("src"), s.alias("dst"))
    )
