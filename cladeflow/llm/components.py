"""Connected components by alternating large-star and small-star steps.

Edges stay a distributed table. A step sends each node the least node it knows,
and rewires its neighbours to that; no step gathers a node's neighbours in one
row, so a hub of any degree only makes a key with many rows, which Spark splits.
Each step is staged, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a != b").unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node of its component, for all nodes with an edge.

    edges: columns a and b, of one type that can be compared; loops, repeats and
    either direction may occur, rows with a null are left out.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), *(
        F.col(c).isNull().alias(f"no_{c}") for c in "ab"
    )).filter("a != b and not no_a and not no_b").select("a", "b").distinct()
    edges = stage(edges)
    before = None
    while (now := _state(edges)) != before:
        before = now
        last, edges = edges, stage(_small_star(_large_star(edges)).distinct())
        unstage(last)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    out.staged_path = edges.staged_path  # so that it can be unstaged
    return out
