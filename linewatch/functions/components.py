"""Connected components of an undirected graph given as edges, in few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each node to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of each node, and the node itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select("u", F.col("m").alias("v"))
    return moved.union(own).filter("u <> v").distinct()


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` with the smallest node of each component as its root; nodes without edges are not listed."""
    current = materialise(edges.select("u", "v").filter("u <> v").distinct())
    seen = _print_of(current)
    while True:
        current = materialise(_small_star(_large_star(current)))
        now = _print_of(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
