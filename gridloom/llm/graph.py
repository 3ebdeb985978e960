"""Connected components of a graph whose edges are a DataFrame, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import checkpoint


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on each node's smallest neighbour: the larger ones (large star), or the smaller ones and the node itself (small star)."""
    if large:
        directed = edges.union(edges.select("b", "a"))
        least = directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        hung = directed.join(least, "a").filter("b > a").select("b", "low")
        return hung.filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    directed = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = directed.groupBy("a").agg(F.min("b").alias("low"))
    hung = directed.join(least, "a").select(F.col("b").alias("x"), "low").union(least.select("a", "low"))
    return hung.filter("x != low").select(F.col("x").alias("a"), F.col("low").alias("b")).distinct()


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    ``edges`` has two columns of one orderable type; direction, loops, repeats and nulls don't matter. Each pass is
    two aggregations and two joins, cut by a checkpoint in the shared folder; passes grow with the logarithm of the
    number of nodes; its files are ``parts`` at most. A hub is only ever aggregated, or the skewed side of a join that Spark may split.
    """
    a, b = edges.columns
    now = checkpoint(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), parts)
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("a", "b")))
    seen = now.agg(mark).first()[0]
    while seen[0]:
        now = checkpoint(_stars(_stars(now, large=True), large=False), parts)
        then, seen = seen, now.agg(mark).first()[0]
        if then == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
