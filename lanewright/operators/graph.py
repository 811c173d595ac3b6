"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.sources.shared import materialised


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for the nodes of links (a, b); links of a node with itself count for nothing.

    Each round is written to the shared folder. A node's least neighbour is a partial aggregate, and the tables that meet in the
    joins are written ones, so that a node with very many links is split among tasks. Rounds are about the logarithm of the
    longest path.
    """
    now = materialised(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialised(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = materialised(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = materialised(large.groupBy("u").agg(F.min("v").alias("m")))
        met = large.join(low, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialised(small.distinct())
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.bit_xor(F.xxhash64("v", "u", F.lit(1))).alias("g")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
