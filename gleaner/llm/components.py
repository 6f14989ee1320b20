"""Connected components of an edge table by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large star: each node hands its larger neighbours its smallest; small star: the same for smaller ones."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m")) if large else least
    hung = near.join(least, "u")
    if large:
        out = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> node, root (smallest node of its component) of every node that has an edge to another."""
    now = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = C.stored(now, "edges")
    for _ in range(max_rounds):
        # done when no root hangs on another node: every path has one edge, and one root for each node
        over = now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        many = now.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        if not over and not many:
            break
        now = C.stored(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components not finished after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
