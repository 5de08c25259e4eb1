"""Connected components by alternating large-star and small-star steps.

Each step gives every node the least neighbour of its centre; the number of
rounds grows with the logarithm of a component's size, and a hub's edges are
reduced to one minimum per task before they are shuffled. The minima are a table
on shared scratch, so both sides of their join are plain exchanges and Spark
splits the one that holds a hub's edges. Every round is written there, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.scratch import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """For edges (a, b) of comparable ids: node, component (its least node), for
    every node of an edge between two nodes. Nulls and loops link nothing."""
    edges = scratch.keep(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # large star: neighbours above a node go to its least neighbour
        around = _both_ways(edges)
        least = scratch.keep(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        edges_up = scratch.keep(around.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its neighbours below go to the least of these
        below_least = scratch.keep(edges_up.groupBy("a").agg(F.min("b").alias("m")))
        below = edges_up.join(below_least, "a")
        moved = below.select(F.col("b").alias("a"), F.col("m").alias("b")).union(below_least.select("a", F.col("m").alias("b")))
        after = scratch.keep(moved.where(F.col("a") != F.col("b")).distinct())
        scratch.drop(edges, least, edges_up, below_least)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
