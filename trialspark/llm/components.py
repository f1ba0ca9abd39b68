"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    # xor of row hashes and a count tell whether the edge set has changed
    row = edges.agg(F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return row["h"], row["n"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): the smallest node reachable.

    Each round is two group minima with map-side combine and a join that AQE
    may split, so a node with very many edges is no single task; rounds grow
    with the logarithm of the longest path. Every round is written to the
    shared folder, so nothing hangs on an executor.
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = stored(down.distinct(), "large-star")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "small-star")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
