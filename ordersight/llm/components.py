"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (long columns a and b); comp is the smallest node it reaches.

    Each round is joins and minima over the edge table, written to the shared folder; the rounds grow
    with the logarithm of the component's width. A hub is only ever a join key, never one group.
    """
    stars = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        seen = tuple(state)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
