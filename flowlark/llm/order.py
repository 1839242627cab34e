"""Places of rows in a total order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlark.session import cut_lineage


def in_order(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """The rows with their place, from 0, in the order of the keys; written once, sorted in range partitions.

    Ranges are cut by the keys, so these should differ from row to row; rows alike in all of them
    get neighbouring places in any order. One number per partition is added up and broadcast.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    # The id holds the partition in its upper bits and the row's place in it in the lower 33.
    spread = cut_lineage(spread.withColumn("_id", F.monotonically_increasing_id()))
    placed = spread.withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_id", "_before")
