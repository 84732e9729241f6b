"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nameshift.session import stage


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1] or 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node with a link.

    Alternating star contraction: every node hands its larger neighbours to its smallest one, then its smaller
    ones, until the links are stars around the smallest node. A node's neighbours are only ever reduced to their
    minimum (pre-aggregated before the shuffle) and joined, so a node with a third of all links is no one task's list.
    Rounds grow with the logarithm of the longest chain. Nulls and links to itself are left out; repeated links count once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND u > v").distinct()
    edges = stage(edges, "links")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.where("u > v").distinct(), "links")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
