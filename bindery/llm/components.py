"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.staging import staged


def _mark(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(hashed)).head())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) edges; a component is named by its least node.

    Alternates two steps until nothing changes: every node sends its larger neighbours, then
    its smaller ones, to the least node it knows. Neighbourhoods are never gathered: only
    their least node is, by an aggregate, and joined back. Each round is written to the shared
    folder, so its lineage ends there; the number of rounds grows with the logarithm of the
    longest path. Whether a round changed anything is told by the number of edges and the sum
    of their hashes. No edges give no rows.
    """
    now = staged(
        edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(),
        "edges",
    )
    mark = _mark(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = (
            large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
        ).distinct()
        now = staged(star, "edges")
        mark, before = _mark(now), mark
        if mark == before:  # both steps leave a forest of stars as it is
            break
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
