"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the smallest node reachable) for all ends of edges (a, b); by alternating large-star and small-star steps.

    Each step hangs the neighbours of a node onto the smallest of them; both steps keep the number of edges, and the
    rounds grow with the logarithm of the graph's size. Steps are stored, so a lost executor costs one step.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}0")
    before, turn = None, 0
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        turn += 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Stored, so that the join may split a node with very many neighbours: an aggregate made on the way would forbid it.
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), f"{name}low{turn}")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        e = stored(small, f"{name}{turn}")
        now = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def tops(parents: DataFrame, name: str = "tops") -> DataFrame:
    """node, root of a forest (a, b): b is the one parent of a, smaller than a; roots themselves are left out. Heights halve each round."""
    p, turn = stored(parents.select("a", "b"), f"{name}0"), 0
    while True:
        turn += 1
        higher = p.join(p.select(F.col("a").alias("b"), F.col("b").alias("up")), "b", "left")
        p = stored(higher.select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved")), f"{name}{turn}")
        if p.filter("moved").isEmpty():
            return p.select(F.col("a").alias("node"), F.col("b").alias("root"))
        p = p.select("a", "b")
