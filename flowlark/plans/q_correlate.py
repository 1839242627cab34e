"""Correlation queries over the predictions view."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.functions.expr import stamp
from flowlark.operators import correlate as C
from flowlark.operators import joins as J
from flowlark.plans.registry import query
from flowlark.sources.tables import view, with_views


def values(rows) -> str:
    def text(v):
        if v is None:
            return "null"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


MITRE = f"mitre(label, mitre_id, technique, tactic) as (values {values(fixed.CORRELATION_MITRE)})"

GROUPS = (
    with_views("predictions")
    + """, groups as (select src_ip, date_trunc('minute', ts) as b, predicted_label, count(*) as alert_count,
  (2 * sum(cast(round(confidence * 1000000) as bigint)) + 1000 * count(confidence)) // (2000 * count(confidence)) / 1000.0::double as c, min(ts) as first_seen, max(ts) as last_seen,
  string_agg(distinct cast(dst_port as varchar), ',' order by cast(dst_port as varchar)) as dst_ports,
  string_agg(distinct protocol, ',' order by protocol) as protocols
from predictions where predicted_label is distinct from 'BENIGN' group by all), """
    + MITRE
    + """, ev as (select g.*, c as avg_confidence,
  case when alert_count >= 25 then 'CRITICAL' when alert_count >= 10 then 'HIGH' when alert_count >= 3 then 'MEDIUM'
    else 'LOW' end as severity, coalesce(mitre_id, 'T????') as mid, coalesce(technique, 'Unknown Technique') as tech,
  coalesce(tactic, 'Unknown Tactic') as tac
from groups g left join mitre m on m.label = g.predicted_label where alert_count >= 3)
"""
)
TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def events(spark, sf):
    return C.correlated_events(C.alert_groups(view(spark, sf, "predictions")))


@query(
    "correlate_alerts",
    GROUPS
    + f"""select src_ip, {TEXT.format('b')} as time_bucket, predicted_label, alert_count, avg_confidence,
  {TEXT.format('first_seen')} as first_seen, {TEXT.format('last_seen')} as last_seen, dst_ports, protocols, severity,
  mid as mitre_id, tech as technique, tac as tactic from ev""",
)
def correlate_alerts(spark, sf):
    out = C.correlate_alerts(view(spark, sf, "predictions"))
    return out.select(
        "src_ip", stamp(F.col("time_bucket")).alias("time_bucket"), "predicted_label", "alert_count", "avg_confidence",
        stamp(F.col("first_seen")).alias("first_seen"), stamp(F.col("last_seen")).alias("last_seen"),
        F.array_join(F.array_sort(F.transform("dst_ports", lambda p: p.cast("string"))), ",").alias("dst_ports"),
        F.array_join("protocols", ",").alias("protocols"), "severity", "mitre_id", "technique", "tactic",
    )


@query(
    "count_severity",
    with_views("predictions")
    + """select src_ip, count(*) as n, case when count(*) >= 25 then 'CRITICAL' when count(*) >= 10 then 'HIGH'
  when count(*) >= 3 then 'MEDIUM' else 'LOW' end as severity
from predictions group by src_ip""",
)
def count_severity(spark, sf):
    n = view(spark, sf, "predictions").groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("severity", C.count_severity(F.col("n")))


@query(
    "mitre_enrich",
    with_views("predictions")
    + ", "
    + MITRE
    + """select packet_id, predicted_label, coalesce(mitre_id, 'T????') as mitre_id,
  coalesce(technique, 'Unknown Technique') as technique, coalesce(tactic, 'Unknown Tactic') as tactic
from predictions left join mitre on label = predicted_label""",
)
def mitre_enrich(spark, sf):
    return J.mitre_enrich(view(spark, sf, "predictions").select("packet_id", "predicted_label"))


@query(
    "noise_reduction",
    GROUPS
    + """select cast((select count(*) from predictions where predicted_label is distinct from 'BENIGN') as bigint) as raw_alerts,
  cast((select count(*) from groups where alert_count < 3) as bigint) as suppressed_groups,
  cast((select count(*) from ev) as bigint) as correlated_events,
  round((1 - (select count(*) from ev) / greatest((select count(*) from predictions
    where predicted_label is distinct from 'BENIGN'), 1)::double) * 100, 4) as noise_reduction_pct""",
)
def noise_reduction(spark, sf):
    out = C.noise_reduction(view(spark, sf, "predictions"))
    return out.withColumn("noise_reduction_pct", F.round("noise_reduction_pct", 4))


@query(
    "severity_breakdown",
    GROUPS
    + """select d.i as severity_rank, d.s as severity, count(ev.severity) as n_events
from (values (0, 'CRITICAL'), (1, 'HIGH'), (2, 'MEDIUM'), (3, 'LOW')) d(i, s) left join ev on ev.severity = d.s group by 1, 2""",
)
def severity_breakdown(spark, sf):
    return C.severity_breakdown(events(spark, sf))


@query(
    "top_attackers",
    GROUPS
    + """select src_ip, cast(sum(alert_count) as bigint) as total_alerts from ev group by 1
order by 2 desc, 1 limit 10""",
)
def top_attackers(spark, sf):
    return C.top_attackers(events(spark, sf))


@query(
    "attack_summary",
    GROUPS
    + """select predicted_label, mid as mitre_id, tac as tactic, count(*) as events,
  cast(sum(alert_count) as bigint) as total_alerts from ev group by 1, 2, 3""",
)
def attack_summary(spark, sf):
    return C.attack_summary(events(spark, sf))


@query("tactic_coverage", GROUPS + "select tac as tactic, count(*) as events, cast(sum(alert_count) as bigint) as total_alerts from ev group by 1")
def tactic_coverage(spark, sf):
    return C.tactic_coverage(events(spark, sf))


@query(
    "critical_events",
    with_views("predictions")
    + """, groups as (select src_ip, time_bucket(interval 10 minutes, ts) as b, predicted_label, count(*) as n,
  (2 * sum(cast(round(confidence * 1000000) as bigint)) + 1000 * count(confidence)) // (2000 * count(confidence)) / 1000.0::double as c,
  min(ts) as first_seen from predictions where predicted_label <> 'BENIGN' group by all), """
    + MITRE
    + f"""select src_ip, predicted_label, n as alert_count, c as avg_confidence, {TEXT.format('first_seen')} as first_seen,
  mitre_id, technique from groups left join mitre on label = predicted_label where n >= 25
order by n desc, src_ip, first_seen, predicted_label limit 10""",
)
def critical_events(spark, sf):
    groups = C.alert_groups(view(spark, sf, "predictions"), seconds=600)
    worst = C.critical_events(C.correlated_events(groups))
    return worst.withColumn("first_seen", stamp(F.col("first_seen")))


@query(
    "alert_timeline",
    GROUPS
    + f"select {TEXT.format('time_bucket(interval 10 minutes, first_seen)')} as bucket, cast(sum(alert_count) as bigint) as alerts from ev group by 1",
)
def alert_timeline(spark, sf):
    return C.alert_timeline(events(spark, sf)).withColumn("bucket", stamp(F.col("bucket")))
