"""Connected components of links, by alternating star contractions over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import coarse, stored


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _contract(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node links its larger neighbours to the smallest node around it; small star: its smaller ones and itself."""
    around = _mirrored(edges)
    if not large:
        around = around.filter("b < a")
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "_a")
    near = around.join(least, F.col("a") == F.col("_a"))
    if large:
        moved = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes that have a link; `edges` has a and b.

    Each round leaves the components as they are and shortens the ways in them, until every node is linked to the smallest one
    only.  The table never has more edges than links, and a round is a few joins; rounds grow with the logarithm of the longest way.
    """
    mark = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    current = stored(edges.select("a", "b").filter("a <> b").distinct(), "links")
    seen = tuple(current.agg(*mark).first())
    while True:
        current = stored(coarse(_contract(_contract(current, True), False), seen[0]), "links")
        now = tuple(current.agg(*mark).first())
        if now == seen:
            break
        seen = now
    tree = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tree.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
