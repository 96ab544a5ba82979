"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star. Each edge is (u, v) with v < u, and stays that way.

    The minimum of a node's neighbours is an aggregate that is joined back, so that a hub's
    neighbours are spread over tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    up = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(u, v): each node that isn't its component's smallest, with that smallest node.

    ``edges`` has two bigint columns u and v; direction and repeats don't matter. Each round is
    written to the shared folder. Rounds grow with the logarithm of the longest path."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        nodes = now.agg(F.count("*").alias("n"), F.count_distinct("u").alias("u")).first()
        if nodes["n"] == nodes["u"] and now.select(F.col("v").alias("u")).distinct().join(now.select("u"), "u", "left_semi").isEmpty():
            return now
        now = stored(_stars(now), "edges")
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
