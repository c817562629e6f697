"""Connected components of a graph given by its edges, in alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to its smallest one.

    edges has u > v. Work per node is an aggregate and a join on the node, so a hub with a
    third of all edges is pre-aggregated and its join can be split by adaptive execution.
    """
    around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    near = around.filter("v > u") if large else around
    moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("least").alias("v")))
    return moved.filter("u != v").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """id, component (its smallest id) of every node of links (a, b)."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    for _ in range(most):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        step = staged(_star(_star(edges, True), False), "edges")
        unstage(edges)
        edges = step
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
