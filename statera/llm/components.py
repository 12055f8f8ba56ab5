"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import materialise


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(b, m) for each edge, m from ``least`` (a, m). The null-safe comparison has the groups dealt anew, the form in which AQE splits a hub's edges."""
    named = least.select(F.col("a").alias("node"), "m")
    return edges.join(named, F.col("a").eqNullSafe(F.col("node"))).select("b", "m")


def large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them. Here a > b holds in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(edges, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long), where root is the smallest node reachable.

    A node that is its own root has a row too. Rounds go on until an edge table repeats; each is written to the shared
    folder, so lineage stays short. Degenerate edges (a = b, or a null end) are ignored; no edges give no rows. Only a
    count and a checksum of the edges reach the driver.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        edges = materialise(small_star(large_star(edges)).distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
