"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrail.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. A large star hangs each larger neighbour of a node on the smallest of its neighbourhood,
    a small star each smaller neighbour and the node itself. Minima are combined before the shuffle and joined back, so
    a node with very many neighbours is split like any skewed join key."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """links: (a, b) of one orderable type. Returns (node, component): the smallest node reachable, for each node that has
    a link to another. Links from a node to itself and nulls are ignored. Rounds end when the links no longer change;
    each is written and read back. The driver sees a count and a checksum per round."""
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = stored(edges, name), None
    while not edges.isEmpty():
        edges = stored(_star(_star(edges, True), False), name)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
