"""Correlated events and running totals on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.operators.correlate import correlated_events, mean_confidence
from flowlark.operators.profile import mode_counters


def correlate_stream(predictions: DataFrame, seconds: int = 60, delay: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Correlated events in append mode: a bucket comes out once the watermark has passed it.

    The state is one row per open (source, bucket, label); later rows than `delay` are dropped.
    """
    marked = predictions.withWatermark(ts, delay)
    bucket = F.window(F.col(ts), f"{seconds} seconds")
    groups = marked.filter(~F.col("predicted_label").eqNullSafe("BENIGN")).filter(F.col("src_ip").isNotNull() & F.col("predicted_label").isNotNull())
    sums = groups.groupBy(bucket.alias("w"), "src_ip", "predicted_label").agg(
        F.count(F.lit(1)).alias("alert_count"), mean_confidence().alias("avg_confidence"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.sort_array(F.collect_set("dst_port")).alias("dst_ports"), F.sort_array(F.collect_set("protocol")).alias("protocols"),
    )
    return correlated_events(sums.withColumn("time_bucket", F.col("w.start")).drop("w"))


def counters_stream(flows: DataFrame) -> DataFrame:
    """Running totals per mode; run in complete mode."""
    return mode_counters(flows)

