"""Threshold rules, specialist routing and the two-stage cascade, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.functions import fixed


def rule_binary() -> Column:
    """1 when at least one of five threshold rules holds."""
    rules = [
        F.col("packet_rate") > 80,
        F.col("byte_rate") > 50000,
        F.col("total_packets") > 120,
        F.upper("protocol") == "ICMP",
        F.col("dst_port").isin(21, 22, 23, 3389, 4444, 8080),
    ]
    hits = sum((F.when(r, 1).otherwise(0) for r in rules[1:]), F.when(rules[0], 1).otherwise(0))
    return F.when(hits >= 1, 1).otherwise(0)


def rule_attack_type() -> Column:
    """The first matching rule names the attack; benign where no binary rule holds."""
    named = (
        F.when((F.upper("protocol") == "ICMP") & (F.col("packet_rate") > 100), "ddos")
        .when(F.col("dst_port").isin(21, 22) & (F.col("packet_rate") > 40), "brute_force")
        .when(F.col("dst_port").isin(80, 443, 8080) & (F.col("total_packets") > 90), "web_attack")
        .when(F.col("dst_port").isin(53, 161), "reconnaissance")
        .when(F.col("dst_port").isin(3389, 4444), "bot")
        .when(F.col("total_packets") > 140, "dos")
        .otherwise("benign")
    )
    return F.when(rule_binary() == 0, "benign").otherwise(named)


def rule_anomaly() -> Column:
    return F.when((F.col("packet_rate") > 120) | (F.col("total_packets") > 180), -1).otherwise(1)


def score_by_rules(df: DataFrame) -> DataFrame:
    return df.select(
        "*", rule_binary().alias("rule_binary"), rule_attack_type().alias("rule_attack_type"), rule_anomaly().alias("rule_anomaly")
    )


def routing_classes(specialist: list[str]) -> list[str]:
    return sorted(set(c for c in specialist if c != "BENIGN") | set(fixed.WEB_FAMILY))


def route_triggers(
    label: Column, confidence: Column, specialist: list[str] = (), threshold: float = fixed.ROUTE_CONFIDENCE
) -> tuple[Column, Column]:
    """(routed for its label, routed for low confidence in an adjacent class)"""
    by_label = label.isin(*routing_classes(list(specialist)))
    by_confidence = label.isin(*fixed.ADJACENT) & (confidence < threshold)
    return by_label, by_confidence


def ensemble_route(
    df: DataFrame,
    specialist_label: str = "specialist_label",
    specialist: list[str] = (),
    threshold: float = fixed.ROUTE_CONFIDENCE,
) -> DataFrame:
    """Adds the two triggers, `routed`, and `final_label` from prediction columns.

    Needs `general_label` and `general_confidence`, and the specialist's label at least
    where the row is routed. One row is one flow, so this is a plain projection.
    """
    by_label, by_confidence = route_triggers(F.col("general_label"), F.col("general_confidence"), specialist, threshold)
    routed = by_label | by_confidence
    return df.select(
        "*",
        by_label.cast("int").alias("label_trigger"),
        by_confidence.cast("int").alias("confidence_trigger"),
        routed.cast("int").alias("routed"),
        F.when(routed, F.col(specialist_label)).otherwise(F.col("general_label")).alias("final_label"),
    )


def route_and_score(df: DataFrame, score, key: str = "row_id", specialist: list[str] = (), threshold: float = fixed.ROUTE_CONFIDENCE):
    """Runs the specialist on routed rows only and joins its labels back.

    `score` takes the routed rows and returns key and `specialist_label`.
    """
    by_label, by_confidence = route_triggers(F.col("general_label"), F.col("general_confidence"), specialist, threshold)
    answers = score(df.filter(by_label | by_confidence)).select(key, "specialist_label")
    return ensemble_route(df.join(answers, key, "left"), "specialist_label", specialist, threshold)


def two_stage_cascade(df: DataFrame, threshold: float, probability: str = "probability", second: str = "second_label") -> DataFrame:
    """BENIGN below the stage 1 threshold, the stage 2 label from there on."""
    return df.withColumn("final_label", F.when(F.col(probability) >= threshold, F.col(second)).otherwise("BENIGN"))
