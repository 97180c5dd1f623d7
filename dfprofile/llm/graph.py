"""Connected components by alternating large-star and small-star steps (joins and grouping only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dfprofile.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (its component's smallest node) for every node that has a link.

    Each step reattaches nodes to the smallest node they know, until each component is a star around its
    smallest node; the number of steps follows the logarithm of the largest component.  Hubs are
    pre-aggregated (min) before each shuffle."""
    e = cut(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    # a star: u > v, and no u has another v or is a v itself
    ends = lambda e: e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(
        e.select(F.col("v").alias("x"), F.lit(0).alias("up"))).groupBy("x").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    while ends(e).where("up > 1 or up = 1 and n > 1").limit(1).count():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
