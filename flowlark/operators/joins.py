"""Lookups and alignments as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.functions.expr import inline_table


def mitre_enrich(df: DataFrame, label: str = "predicted_label") -> DataFrame:
    """Adds mitre_id, technique and tactic; an unknown label gets the unknown entry."""
    dim = inline_table(df.sparkSession, fixed.CORRELATION_MITRE, [label, "mitre_id", "technique", "tactic"])
    joined = df.join(F.broadcast(dim), label, "left")
    names = ("mitre_id", "technique", "tactic")
    filled = [F.coalesce(F.col(n), F.lit(d)).alias(n) for n, d in zip(names, fixed.UNKNOWN_MITRE)]
    return joined.select(*df.columns, *filled)


def playbook_steps(spark) -> DataFrame:
    """All playbook steps, one row each."""
    return inline_table(
        spark, fixed.PLAYBOOK_STEPS, ["attack_type", "step", "phase", "technique_id", "technique", "description"]
    )


def _pairs(column: str):
    return F.transform(F.col(column), lambda x: F.struct(x[0].alias("id"), x[1].alias("name")))


def playbook(spark) -> DataFrame:
    """The playbook with nested tactics, techniques and steps, one row per attack type."""
    heads = inline_table(spark, fixed.PLAYBOOK, ["attack_type", "summary", "tactics", "techniques"])
    steps = playbook_steps(spark).groupBy("attack_type").agg(
        F.array_sort(F.collect_list(F.struct("step", "phase", "technique_id", "technique", "description"))).alias("attack_steps")
    )
    return heads.join(steps, "attack_type").select(
        "attack_type",
        F.struct("summary", _pairs("tactics").alias("tactics"), _pairs("techniques").alias("techniques"), "attack_steps").alias("mitre"),
    )


def triage_step():
    step, phase, tid, technique, text = fixed.TRIAGE_STEP
    return F.struct(
        F.lit(step).alias("step"), F.lit(phase).alias("phase"), F.lit(tid).cast("string").alias("technique_id"),
        F.lit(technique).cast("string").alias("technique"), F.lit(text).alias("description"),
    )


def mitre_playbook(df: DataFrame, label: str = "attack_type") -> DataFrame:
    """Adds the nested playbook as `mitre`; labels without one get the triage playbook."""
    pair = "array<struct<id:string,name:string>>"
    triage = F.struct(
        F.lit(fixed.TRIAGE_SUMMARY).alias("summary"), F.array().cast(pair).alias("tactics"),
        F.array().cast(pair).alias("techniques"), F.array(triage_step()).alias("attack_steps"),
    )
    dim = playbook(df.sparkSession).withColumnRenamed("attack_type", label)
    return df.join(F.broadcast(dim), label, "left").select(*df.columns, F.coalesce("mitre", triage).alias("mitre"))


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one last in order. Combined on the map side, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def flows_with_predictions(flows: DataFrame, predictions: DataFrame, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Flow rows with their prediction and alert; the last of duplicate keys wins.

    `predictions` and `alerts` carry `seq`, their order of arrival.
    """
    p = last_per_key(predictions, keys, "seq").drop("seq").withColumn("__has", F.lit(True))
    a = last_per_key(alerts, keys, "seq").drop("seq")
    joined = flows.join(p, keys, "left").join(a, keys, "left")
    bad = F.coalesce(F.col("is_not_benign"), F.lit(False))
    kind = F.coalesce(F.nullif(F.col("attack_type"), F.lit("")), F.nullif(F.col("multiclass_label"), F.lit("")), F.lit("BENIGN"))
    return joined.select(
        *flows.columns,
        F.when(F.col("__has").isNull(), "UNCLASSIFIED").when(bad, "NOT BENIGN").otherwise("BENIGN").alias("binary_label"),
        F.when(F.col("__has").isNull(), "unclassified").when(bad, kind).otherwise("benign").alias("attack_label"),
        F.coalesce("binary_prediction", F.lit(0)).alias("binary_prediction"),
        F.coalesce("binary_confidence", F.lit(0.0)).alias("binary_confidence"),
        F.coalesce("multiclass_confidence", F.lit(0.0)).alias("multiclass_confidence"),
        F.coalesce("anomaly_flag", F.lit(0)).alias("anomaly_flag"),
        F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        *[F.col(c) for c in a.columns if c not in keys],
    )


def features_labels_align(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels, "row_id")


def status_overlay(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest valid status per incident, `open` where none was set. `dismissed` means resolved.

    `changes`: incident_id, status, changed_at, seq.
    """
    valid = changes.withColumn("status", F.when(F.col("status") == "dismissed", "resolved").otherwise(F.col("status")))
    valid = valid.filter(F.col("status").isin("open", "acknowledged", "resolved"))
    latest = valid.groupBy("incident_id").agg(F.max_by("status", F.struct("changed_at", "seq")).alias("__status"))
    base = incidents.drop("status")
    return base.join(latest, "incident_id", "left").select(*base.columns, F.coalesce("__status", F.lit("open")).alias("status"))


def split_leakage(df: DataFrame) -> DataFrame:
    """Source files that occur in more than one split, with the splits."""
    return (
        df.groupBy("source_file")
        .agg(F.sort_array(F.collect_set("split")).alias("splits"))
        .filter(F.size("splits") > 1)
        .select("source_file", F.array_join("splits", ",").alias("splits"))
    )
