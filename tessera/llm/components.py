"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points neighbours of each node at the least id around it: the larger ones, or itself and the smaller ones."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is the centre of a star or a leaf of one; the centre, the lesser end of its edges, is then the root."""
    ends = edges.select(F.col("a").alias("n"), F.lit(0).alias("below")).union(edges.select("b", F.lit(1)))
    return ends.groupBy("n").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("edges")).where("below > 0 and edges > 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the least id of its component. edges: a, b (long).

    Rounds grow with the logarithm of the longest chain; `most_rounds` is far beyond that, and reaching it is an error."""
    edges = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        before, edges = edges, materialize(_star(_star(edges, True), False), "edges")
        dropped(before)
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)
