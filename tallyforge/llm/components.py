"""Connected components by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release

#: Edges in one partition of a round's result.
PART_EDGES = 50_000


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    linked = both.join(least, "a").where(F.col("b") > F.col("a"))
    return linked.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node that each node of an edge can reach.

    ``edges`` has columns a and b, any orientation, repeats and loops allowed; nulls are
    dropped. Nodes without an edge have no row. The smallest node of a component has none
    either: it is its own component. Only the number of edges and a checksum reach the driver.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = checkpointed(links), None
    while True:
        now = links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == before or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        parts = now[0] // PART_EDGES + 1  # few edges lie in few files, whatever the number of shuffle partitions
        last, before = links, now
        links = checkpointed(small_star(large_star(links.coalesce(parts))).coalesce(parts))
        release(last)
