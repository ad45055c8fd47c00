"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.session import checkpointed


def stars(edges: DataFrame) -> bool:
    """Whether every node of distinct edges (a < b) is either a centre or the leaf of one edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("leaf")).union(edges.select("b", F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("leaf").alias("above"), F.min("leaf").alias("leaf"))
    return not nodes.where("above > leaf").agg(F.count("*")).first()[0]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node of each component, for edges (a, b) of long ids.

    Alternating star steps: first every larger neighbour of a node, then every smaller one,
    is tied to the smallest node known nearby.  Minima are aggregated before the shuffle and
    no neighbour list is collected, so a node may have any number of edges.  It ends as soon
    as the edges are stars around smallest nodes.  Rounds grow with the logarithm of the
    graph and are cut by checkpoints; it raises if they run out.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if stars(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # one row per edge at most, so equal ones wait for the end of the round
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        edges = checkpointed(small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct())
    raise RuntimeError("components did not settle")
