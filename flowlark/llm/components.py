"""Connected components of a table of links, by repeated star contraction."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlark.session import cut_lineage


def release(spark: SparkSession) -> None:
    """Has the driver look for plans that nothing uses any more: the shuffle files behind a cut lineage go with them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(links: DataFrame) -> DataFrame:
    """Ties the larger neighbours of each node to its least neighbour."""
    near = both_ways(links)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Ties the smaller neighbours of each node, and itself, to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link (u, v); a component is named by its least node.

    Links may repeat, point either way or to themselves. Each round halves long paths; only a
    count and a checksum of the links come to the driver.
    """
    links = cut_lineage(links.where("u <> v").select("u", "v").distinct())
    before = None
    while True:
        links = cut_lineage(small_star(large_star(links)))
        release(links.sparkSession)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    star = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
