"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import settle


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the smallest node reachable) of every node of `links` that isn't its own root.

    Every round is a few shuffles of the links and is written to the shared folder; the number of
    rounds grows with the logarithm of the longest chain. Null ends and loops are left out."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND u > v").distinct()
    edges, seen = settle(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours hang on the least of the neighbourhood
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the node itself, hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)
