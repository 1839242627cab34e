"""From model outputs to attack types, severities and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.functions.expr import default_text, parse_time
from flowlark.operators.joins import mitre_playbook


def resolve_attack_type() -> Column:
    """A malicious flow keeps its class; without one it is suspicious; anomalies are unknown."""
    label = F.col("multiclass_label")
    named = F.when(label.isNull() | label.isin("", "BENIGN"), "SUSPICIOUS_ACTIVITY").otherwise(label)
    return F.when(F.col("binary_prediction") == 1, named).when(F.col("anomaly_flag") == 1, "UNKNOWN_ANOMALY").otherwise("BENIGN")


def severity_score(attack_type: Column) -> Column:
    """Base by type plus confidence and anomaly points (cut toward zero), kept within 0 to 100."""
    pairs = [F.lit(x) for pair in fixed.SEVERITY_BASE for x in pair]
    base = F.coalesce(F.try_element_at(F.create_map(*pairs), attack_type), F.lit(fixed.SEVERITY_DEFAULT))
    points = (
        base
        + (F.col("binary_confidence") * 10).cast("int")
        + (F.col("anomaly_score") * 5).cast("int")
        + F.when(F.col("anomaly_flag") == 1, 5).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(points, F.lit(100)))


def severity_label(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 75, "high").when(score >= 55, "medium").otherwise("low")


def two_places(value: Column) -> Column:
    """Fixed text with two places, exact ties to the even digit."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit(""))


def reasoning(attack_type: Column) -> Column:
    """Sentences explaining the alert; a single fallback sentence when none applies."""
    binary = F.when(
        F.col("binary_prediction") == 1,
        F.concat(F.lit("Binary detector marked the flow as malicious with confidence "), two_places(F.col("binary_confidence")), F.lit(".")),
    )
    typed = F.when(
        ~attack_type.isin("BENIGN", "UNKNOWN_ANOMALY", "SUSPICIOUS_ACTIVITY"),
        F.concat(
            F.lit("Multiclass detector associated the flow with '"), attack_type, F.lit("' at confidence "),
            two_places(F.col("multiclass_confidence")), F.lit("."),
        ),
    )
    odd = F.when(
        F.col("anomaly_flag") == 1,
        F.concat(F.lit("Isolation Forest also flagged the flow as anomalous with score "), two_places(F.col("anomaly_score")), F.lit(".")),
    )
    found = F.array_compact(F.array(binary, typed, odd))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("The flow stayed below alerting thresholds.")))


def prediction_table(df: DataFrame) -> DataFrame:
    kind = resolve_attack_type()
    return df.select(
        "row_index", "binary_prediction", "binary_confidence", "multiclass_label", "multiclass_confidence", "anomaly_flag",
        "anomaly_score", kind.alias("attack_type"), (kind != "BENIGN").alias("is_not_benign"),
    )


ALERT_TEXT = {"src_ip": ("source_ip", "unknown"), "dst_ip": ("destination_ip", "unknown"), "sensor_id": ("sensor_id", "unspecified"),
              "asset_id": ("asset_id", None), "hostname": ("hostname", None), "username": ("username", None)}


def build_alerts(df: DataFrame, batch: Column, received_at: Column, with_mitre: bool = True) -> DataFrame:
    """One alert per flow that is not BENIGN. Input: flow metadata beside model outputs.

    The id comes from batch and row, so a task that runs twice makes the same alert.
    """
    have = set(df.columns)
    rows = df.withColumn("attack_type", resolve_attack_type()).filter(F.col("attack_type") != "BENIGN")
    row = F.col("row_index").cast("string")
    score = severity_score(F.col("attack_type"))
    flow_id = F.concat(F.lit("flow-"), row)
    stamp = parse_time(F.col("timestamp"), received_at) if "timestamp" in have else received_at
    texts = [
        (default_text(F.col(source), F.lit(default).cast("string")) if source in have else F.lit(default).cast("string")).alias(name)
        for source, (name, default) in ALERT_TEXT.items()
    ]
    ports = [
        (F.col(c) if c in have else F.lit(None)).cast("int").alias(n) for c, n in (("src_port", "source_port"), ("dst_port", "destination_port"))
    ]
    out = rows.select(
        F.concat(F.lit("alert-"), F.substring(F.sha1(F.concat_ws("|", batch, row)), 1, 12)).alias("alert_id"),
        "row_index",
        (default_text(F.col("flow_id"), flow_id) if "flow_id" in have else flow_id).alias("flow_id"),
        stamp.alias("timestamp"),
        *texts,
        *ports,
        "attack_type",
        F.when(F.col("attack_type") == "UNKNOWN_ANOMALY", "anomaly").otherwise("classified_attack").alias("detection_type"),
        severity_label(score).alias("severity"),
        score.alias("severity_score"),
        "binary_prediction", "binary_confidence", "multiclass_confidence", "anomaly_flag", "anomaly_score",
        reasoning(F.col("attack_type")).alias("reasoning"),
    )
    return mitre_playbook(out) if with_mitre else out


def analysis_summary(predictions: DataFrame, incidents: DataFrame) -> DataFrame:
    """Flows received, alerts, open incidents, and alerts per attack type as a map."""
    kinds = predictions.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("attack_type") != "BENIGN"
    flows = kinds.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("flows_received"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("alerts_generated"),
        F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(bad, F.struct("attack_type", "n")))))).alias("attack_type_counts"),
    )
    opened = incidents.agg(F.count(F.lit(1)).alias("incidents_open"))
    return flows.crossJoin(opened)  # one row each
