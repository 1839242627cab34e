"""Alerts to correlated events, and the roll-ups over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.functions.expr import inline_table, is_attack
from flowlark.operators.joins import mitre_enrich

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
KEYS = ["src_ip", "time_bucket", "predicted_label"]


def count_severity(n: Column) -> Column:
    return (
        F.when(n >= fixed.CRITICAL_COUNT, "CRITICAL")
        .when(n >= fixed.HIGH_COUNT, "HIGH")
        .when(n >= fixed.ALERT_THRESHOLD, "MEDIUM")
        .otherwise("LOW")
    )


def severity_rank(severity: Column) -> Column:
    pairs = [F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i)]
    return F.try_element_at(F.create_map(*pairs), severity)


def mean_confidence(value: str = "confidence") -> Column:
    """Average to 3 places, half up, of values from 0 to 1 taken to 6 places.

    Whole millionths are summed and divided once, so the order in which rows arrive makes no difference.
    """
    millionths, n = F.sum(F.round(F.col(value) * 1_000_000).cast("bigint")), F.count(value)
    return F.when(n > 0, F.floor((2 * millionths + 1000 * n).cast("decimal(38,0)") / (2000 * n)).cast("bigint") / F.lit(1000.0))


def alert_groups(df: DataFrame, seconds: int = 60, ts: str = "ts") -> DataFrame:
    """Attack predictions per source, time bucket and label.

    Everything is combined on the map side, so a hot source costs one small partial row
    per task; ports (at most 65,536) and protocols bound the two sets. Rows with a missing
    key go.
    """
    rows = df.filter(is_attack(F.col("predicted_label"))).dropna(subset=["src_ip", ts, "predicted_label"])
    bucket = F.window(F.col(ts), f"{seconds} seconds")["start"]
    return rows.groupBy("src_ip", bucket.alias("time_bucket"), "predicted_label").agg(
        F.count(F.lit(1)).alias("alert_count"),
        mean_confidence().alias("avg_confidence"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.sort_array(F.collect_set("dst_port")).alias("dst_ports"),
        F.sort_array(F.collect_set("protocol")).alias("protocols"),
    )


def correlated_events(groups: DataFrame, threshold: int = fixed.ALERT_THRESHOLD) -> DataFrame:
    """Groups at or above the threshold with severity and ATT&CK columns."""
    kept = groups.filter(F.col("alert_count") >= threshold)
    named = kept.withColumn("severity", count_severity(F.col("alert_count")))
    return mitre_enrich(named)


def correlate_alerts(df: DataFrame, seconds: int = 60, threshold: int = fixed.ALERT_THRESHOLD, ts: str = "ts") -> DataFrame:
    events = correlated_events(alert_groups(df, seconds, ts), threshold)
    return events.orderBy(severity_rank(F.col("severity")), F.col("alert_count").desc(), "src_ip", "time_bucket", "predicted_label")


def noise_reduction(df: DataFrame, seconds: int = 60, threshold: int = fixed.ALERT_THRESHOLD, ts: str = "ts") -> DataFrame:
    """Raw attack rows, suppressed groups, kept groups, and the reduction in percent, in one pass.

    Raw counts every attack row, also those whose missing key keeps them out of all groups.
    """
    bucket = F.window(F.col(ts), f"{seconds} seconds")["start"]
    keyed = F.col("src_ip").isNotNull() & F.col(ts).isNotNull() & F.col("predicted_label").isNotNull()
    groups = (
        df.filter(is_attack(F.col("predicted_label")))
        .select(keyed.alias("keyed"), "src_ip", bucket.alias("b"), "predicted_label")
        .groupBy("keyed", "src_ip", "b", "predicted_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_alerts"),
        F.count(F.when(F.col("keyed") & (F.col("n") < threshold), 1)).alias("suppressed_groups"),
        F.count(F.when(F.col("keyed") & (F.col("n") >= threshold), 1)).alias("correlated_events"),
    )
    share = F.col("correlated_events") / F.greatest(F.col("raw_alerts"), F.lit(1))
    return counted.withColumn("noise_reduction_pct", (1 - share) * 100)


def severity_breakdown(events: DataFrame) -> DataFrame:
    """Events per severity in fixed order, zeros kept."""
    dim = inline_table(events.sparkSession, [(i, s) for i, s in enumerate(SEVERITIES)], ["severity_rank", "severity"])
    counts = events.groupBy("severity").count()
    return dim.join(counts, "severity", "left").select(
        "severity_rank", "severity", F.coalesce("count", F.lit(0)).alias("n_events")
    ).orderBy("severity_rank")


def top_attackers(events: DataFrame, n: int = 10) -> DataFrame:
    totals = events.groupBy("src_ip").agg(F.sum("alert_count").alias("total_alerts"))
    return totals.orderBy(F.col("total_alerts").desc(), "src_ip").limit(n)


def attack_summary(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("predicted_label", "mitre_id", "tactic")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("alert_count").alias("total_alerts"))
        .orderBy(F.col("total_alerts").desc(), "predicted_label")
    )


def tactic_coverage(events: DataFrame) -> DataFrame:
    return events.groupBy("tactic").agg(F.count(F.lit(1)).alias("events"), F.sum("alert_count").alias("total_alerts"))


def critical_events(events: DataFrame, n: int = 10) -> DataFrame:
    columns = ["src_ip", "predicted_label", "alert_count", "avg_confidence", "first_seen", "mitre_id", "technique"]
    worst = events.filter(F.col("severity") == "CRITICAL")
    return worst.orderBy(F.col("alert_count").desc(), "src_ip", "first_seen", "predicted_label").limit(n).select(*columns)


def alert_timeline(events: DataFrame, minutes: int = 10) -> DataFrame:
    """Summed alerts per bucket of first_seen."""
    bucket = F.window("first_seen", f"{minutes} minutes")["start"]
    return events.groupBy(bucket.alias("bucket")).agg(F.sum("alert_count").alias("alerts"))
