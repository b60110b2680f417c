"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import stage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id in ``links``: the smallest id that links reach.

    Each round hooks the larger neighbours of a node to its smallest neighbour, then the smaller
    ones, until all links are stars; rounds grow as the log of the number of ids. Every round is
    grouped minima and joins of id pairs, written to a scratch table; nothing comes to the driver
    but a count and a checksum. Null ids are not allowed; links of an id to itself are ignored.
    """
    e = (links.filter(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = stage(e, "links")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (e.join(least.withColumnRenamed("u", "v"), "v")
                 .select("u", F.col("m").alias("v")).distinct())
        large = stage(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e = stage(small, "small-star")
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
