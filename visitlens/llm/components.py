"""Connected components of a link table, by alternating star steps.

Each round hangs every node's larger neighbours on its smallest one (large
star), then its smaller neighbours and itself (small star).  Both are a
map-side-combined minimum per node and an equi-join, so a node with a third of
all links is a skewed join that Spark splits, never a group in one task.
Rounds grow with the logarithm of a component's size; each ends in the
shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of a link to another one; the component
    is its smallest node.  Links are undirected; loops, repeats and NULLs are
    ignored; without links the result is empty."""
    edges = cut(links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
                .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every edge is (larger, smaller) now
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        edges = cut(small)
        before, state = state, _state(edges)
        if state == before:
            break
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
