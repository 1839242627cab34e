"""Alerts grouped into incidents.

An incident is kept in two tables: its header, built from aggregates that combine on the
map side, and its alerts as rows carrying the incident id. A nested list of all alerts
would put an unbounded group into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.functions.expr import minute_bucket
from flowlark.operators.joins import playbook_steps, triage_step

KEYS = ["source_ip", "destination_ip", "sensor_id", "window_start"]


def iso(ts: Column) -> Column:
    """Whole-second ISO text with the UTC offset, as ids are made from it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss+00:00")


def with_incident(alerts: DataFrame, minutes: int = 5) -> DataFrame:
    """Alerts with their window start and incident id."""
    keyed = alerts.withColumn("window_start", minute_bucket(F.col("timestamp"), minutes))
    text = F.concat_ws("|", "source_ip", "destination_ip", "sensor_id", iso(F.col("window_start")))
    return keyed.withColumn("incident_id", F.concat(F.lit("incident-"), F.substring(F.sha1(text), 1, 14)))


def _step_library() -> Column:
    """Playbook steps as a constant map: attack type to its steps."""
    entries = []
    for kind in dict.fromkeys(row[0] for row in fixed.PLAYBOOK_STEPS):
        steps = [
            F.struct(
                F.lit(fixed.TACTICS.index(phase)).alias("rank"), F.lit(tid).alias("technique_id"), F.lit(phase).alias("phase"),
                F.lit(technique).alias("technique"), F.lit(text).alias("description"),
            )
            for k, _, phase, tid, technique, text in fixed.PLAYBOOK_STEPS
            if k == kind
        ]
        entries += [F.lit(kind), F.array(*steps)]
    return F.create_map(*entries)


def attack_progression(types: Column) -> Column:
    """One ordered story for a sorted array of attack types: steps in tactic order, doubles
    dropped, renumbered from 1. Types without a playbook add the triage step, last."""
    step = triage_step()
    triage = F.array(
        F.struct(
            F.lit(len(fixed.TACTICS)).alias("rank"), step["technique_id"].alias("technique_id"), step["phase"].alias("phase"),
            step["technique"].alias("technique"), step["description"].alias("description"),
        )
    )
    library = _step_library()
    found = F.array_distinct(F.flatten(F.transform(types, lambda t: F.coalesce(F.try_element_at(library, t), triage))))
    placed = F.transform(
        found,
        lambda s, i: F.struct(
            s["rank"].alias("rank"), F.coalesce(s["technique_id"], F.lit("")).alias("tid"), i.alias("at"), s["phase"].alias("phase"),
            s["technique_id"].alias("technique_id"), s["technique"].alias("technique"), s["description"].alias("description"),
        ),
    )
    return F.transform(
        F.array_sort(placed),
        lambda s, i: F.struct(
            (i + 1).alias("step"), s["phase"].alias("phase"), s["technique_id"].alias("technique_id"),
            s["technique"].alias("technique"), s["description"].alias("description"),
        ),
    )


def header_aggregates() -> list[Column]:
    """The aggregates of an incident header; the same ones serve batch and stream.

    The primary type is that of the highest score, the earliest alert winning ties.
    """
    order = F.struct("severity_score", -F.unix_micros("timestamp"), -F.col("row_index"))
    return [
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("alert_count"),
        F.sort_array(F.collect_set("attack_type")).alias("attack_types"),
        F.max_by(F.struct("attack_type", "severity", "severity_score"), order).alias("worst"),
    ]


def finish_headers(groups: DataFrame, minutes: int) -> DataFrame:
    return groups.select(
        "incident_id", *KEYS, F.lit(minutes).alias("window_minutes"), "first_seen", "last_seen", "alert_count",
        F.greatest(F.col("alert_count") - F.size("attack_types"), F.lit(0)).alias("suppressed_duplicates"),
        "attack_types",
        F.col("worst.attack_type").alias("primary_attack_type"),
        F.col("worst.severity").alias("severity"),
        F.col("worst.severity_score").alias("severity_score"),
        attack_progression(F.col("attack_types")).alias("mitre_attack_steps"),
        F.lit("open").alias("status"),
    )


def incidents(alerts: DataFrame, minutes: int = 5) -> DataFrame:
    """Incident headers: one per source, destination, sensor and time bucket."""
    if minutes <= 0:
        raise ValueError("the correlation window must be a positive number of minutes")
    groups = with_incident(alerts, minutes).groupBy("incident_id", *KEYS).agg(*header_aggregates())
    return finish_headers(groups, minutes)


def upsert_incidents(batches: DataFrame, minutes: int = 5) -> DataFrame:
    """Incidents over alerts of several batches; an alert delivered again counts once."""
    return incidents(batches.dropDuplicates(["alert_id"]), minutes)


def active_incidents(headers: DataFrame, as_of: str, retention_minutes: int = 60) -> DataFrame:
    """Incidents last seen within the retention time, newest first."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {int(retention_minutes)} minutes")
    return headers.filter(F.col("last_seen") >= cutoff).orderBy(F.col("last_seen").desc(), "incident_id")


def correlation_lines(headers: DataFrame) -> DataFrame:
    attacks = F.array_join("attack_types", ", ")
    line = F.concat(
        F.col("incident_id"), F.lit(" | "), F.upper("severity"), F.lit(" | "), F.col("source_ip"), F.lit(" -> "), F.col("destination_ip"),
        F.lit(" | "), F.col("alert_count").cast("string"), F.lit(" alerts | "),
        F.when(attacks == "", F.col("primary_attack_type")).otherwise(attacks),
    )
    return headers.select("incident_id", line.alias("line"))


def mitre_catalog(spark) -> DataFrame:
    """The playbook as rows: attack type, tactics, techniques, and each step."""
    from flowlark.functions.expr import inline_table

    heads = inline_table(spark, fixed.PLAYBOOK, ["attack_type", "summary", "tactics", "techniques"])
    return heads.join(F.broadcast(playbook_steps(spark)), "attack_type").select(
        "attack_type", *[F.array_join(F.transform(c, lambda x: F.array_join(x, ":")), ";").alias(c) for c in ("tactics", "techniques")],
        "step", "phase", "technique_id", "technique", "description",
    )
