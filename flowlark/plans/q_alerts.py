"""Scoring rules, alerts, incidents and joins over the flow and model-output views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.functions.expr import default_text, parse_time, stamp
from flowlark.operators import alerts as D
from flowlark.operators import clean as P
from flowlark.operators import incidents as I
from flowlark.operators import joins as J
from flowlark.operators import profile as A
from flowlark.operators import rules as R
from flowlark.plans.q_correlate import TEXT, values
from flowlark.plans.registry import query
from flowlark.sources import flow_files as S
from flowlark.sources.tables import view, with_views

BASE = f"base(kind, points) as (values {values(fixed.SEVERITY_BASE)})"
KIND = """case when binary_prediction = 1 then case when multiclass_label is null or multiclass_label in ('', 'BENIGN')
  then 'SUSPICIOUS_ACTIVITY' else multiclass_label end when anomaly_flag = 1 then 'UNKNOWN_ANOMALY' else 'BENIGN' end"""
SCORE = """cast(greatest(0, least(100, coalesce(points, 55) + cast(trunc(binary_confidence * 10) as int)
  + cast(trunc(anomaly_score * 5) as int) + case when anomaly_flag = 1 then 5 else 0 end)) as int)"""
LEVEL = "case when {0} >= 90 then 'critical' when {0} >= 75 then 'high' when {0} >= 55 then 'medium' else 'low' end"

ALERTS = (
    with_views("flows", "model_predictions")
    + f""", {BASE}, typed as (select f.*, m.* exclude (row_index), {KIND} as attack_type
  from flows f join model_predictions m using (row_index)),
sc as (select typed.*, {SCORE} as severity_score from typed left join base on base.kind = typed.attack_type),
al as (select *, {LEVEL.format('severity_score')} as severity, src_ip as source_ip, dst_ip as destination_ip,
  case when trim(sensor_id) = '' then 'unspecified' else sensor_id end as sensor,
  'alert-' || substr(sha1('b1|' || row_index), 1, 12) as alert_id from sc where attack_type <> 'BENIGN'),
ik as (select *, date_trunc('hour', received_at) + to_minutes(cast(minute(received_at) // 5 * 5 as bigint)) as ws from al),
inc as (select 'incident-' || substr(sha1(source_ip || '|' || destination_ip || '|' || sensor || '|' ||
    strftime(ws, '%Y-%m-%dT%H:%M:%S+00:00')), 1, 14) as incident_id, source_ip, destination_ip, sensor as sensor_id, ws,
  min(received_at) as first_seen, max(received_at) as last_seen, count(*) as alert_count,
  count(*) - count(distinct attack_type) as suppressed_duplicates,
  string_agg(distinct attack_type, ',' order by attack_type) as attack_types,
  arg_max(attack_type, severity_score * 1e18::hugeint - epoch_us(received_at) * 100::hugeint) as primary_attack_type,
  max(severity_score) as severity_score from ik group by source_ip, destination_ip, sensor, ws)
"""
)


def scored(spark, sf) -> DataFrame:
    """Flow metadata beside model outputs."""
    return view(spark, sf, "flows").join(view(spark, sf, "model_predictions"), "row_index")


def alerts(spark, sf, with_mitre=False) -> DataFrame:
    return D.build_alerts(scored(spark, sf), F.lit("b1"), F.col("received_at"), with_mitre)


def headers(spark, sf) -> DataFrame:
    return I.incidents(alerts(spark, sf))


def listed(pairs) -> str:
    return ";".join(f"{key}:{name}" for key, name in pairs)


@query(
    "rule_binary",
    with_views("flows")
    + """ select row_index, cast(packet_rate > 80 or byte_rate > 50000 or total_packets > 120 or upper(protocol) = 'ICMP'
  or dst_port in (21, 22, 23, 3389, 4444, 8080) as int) as rule_binary from flows""",
)
def rule_binary(spark, sf):
    return view(spark, sf, "flows").select("row_index", R.rule_binary().alias("rule_binary"))


@query(
    "rule_attack_type",
    with_views("flows")
    + """ select row_index, case when not (packet_rate > 80 or byte_rate > 50000 or total_packets > 120 or upper(protocol) = 'ICMP'
  or dst_port in (21, 22, 23, 3389, 4444, 8080)) then 'benign' when upper(protocol) = 'ICMP' and packet_rate > 100 then 'ddos'
  when dst_port in (21, 22) and packet_rate > 40 then 'brute_force' when dst_port in (80, 443, 8080) and total_packets > 90 then 'web_attack'
  when dst_port in (53, 161) then 'reconnaissance' when dst_port in (3389, 4444) then 'bot' when total_packets > 140 then 'dos'
  else 'benign' end as rule_attack_type from flows""",
)
def rule_attack_type(spark, sf):
    return view(spark, sf, "flows").select("row_index", R.rule_attack_type().alias("rule_attack_type"))


@query(
    "rule_anomaly",
    with_views("flows") + " select row_index, case when packet_rate > 120 or total_packets > 180 then -1 else 1 end as rule_anomaly from flows",
)
def rule_anomaly(spark, sf):
    return view(spark, sf, "flows").select("row_index", R.rule_anomaly().alias("rule_anomaly"))


@query(
    "resolve_attack_type",
    with_views("model_predictions")
    + f""", b as (select * replace (case when multiclass_confidence >= 0.9 then '' else multiclass_label end as multiclass_label)
  from model_predictions) select row_index, {KIND} as attack_type from b""",
)
def resolve_attack_type(spark, sf):
    rows = view(spark, sf, "model_predictions")
    blank = F.when(F.col("multiclass_confidence") >= 0.9, "").otherwise(F.col("multiclass_label"))
    return rows.withColumn("multiclass_label", blank).select("row_index", D.resolve_attack_type().alias("attack_type"))


@query("severity_score", ALERTS + " select row_index, attack_type, severity_score from sc")
def severity_score(spark, sf):
    rows = scored(spark, sf).withColumn("attack_type", D.resolve_attack_type())
    return rows.select("row_index", "attack_type", D.severity_score(F.col("attack_type")).alias("severity_score"))


@query("severity_label", ALERTS + f" select row_index, {LEVEL.format('severity_score')} as severity from sc")
def severity_label(spark, sf):
    rows = scored(spark, sf).withColumn("attack_type", D.resolve_attack_type())
    return rows.select("row_index", D.severity_label(D.severity_score(F.col("attack_type"))).alias("severity"))


@query(
    "reasoning",
    ALERTS
    + """ select row_index, concat_ws(' ', case when binary_prediction = 1 then
    printf('Binary detector marked the flow as malicious with confidence %.2f.', binary_confidence) end,
  case when attack_type not in ('BENIGN', 'UNKNOWN_ANOMALY', 'SUSPICIOUS_ACTIVITY') then
    printf('Multiclass detector associated the flow with ''%s'' at confidence %.2f.', attack_type, multiclass_confidence) end,
  case when anomaly_flag = 1 then printf('Isolation Forest also flagged the flow as anomalous with score %.2f.', anomaly_score) end,
  case when binary_prediction <> 1 and anomaly_flag <> 1 then 'The flow stayed below alerting thresholds.' end) as reasons from sc""",
)
def reasoning(spark, sf):
    rows = scored(spark, sf).withColumn("attack_type", D.resolve_attack_type())
    return rows.select("row_index", F.array_join(D.reasoning(F.col("attack_type")), " ").alias("reasons"))


STEPS = f"steps(kind, step, phase, tid, technique, description) as (values {values(fixed.PLAYBOOK_STEPS)})"


@query(
    "build_alerts",
    ALERTS
    + f""", {STEPS}, n as (select kind, count(*) as n from steps group by 1)
select alert_id, row_index, 'flow-' || row_index as flow_id, {TEXT.format('received_at')} as at, source_ip, destination_ip, src_port as source_port,
  dst_port as destination_port, sensor as sensor_id, attack_type, case attack_type when 'UNKNOWN_ANOMALY' then 'anomaly' else 'classified_attack' end
  as detection_type, severity, severity_score, coalesce(n, 1) as n_steps from al left join n on n.kind = al.attack_type""",
)
def build_alerts(spark, sf):
    return alerts(spark, sf, True).select(
        "alert_id", "row_index", "flow_id", stamp(F.col("timestamp")).alias("at"), "source_ip", "destination_ip", "source_port",
        "destination_port", "sensor_id", "attack_type", "detection_type", "severity", "severity_score",
        F.size("mitre.attack_steps").cast("bigint").alias("n_steps"),
    )


@query("prediction_table", ALERTS + " select row_index, binary_prediction, multiclass_label, anomaly_flag, attack_type, cast(attack_type <> 'BENIGN' as int) as is_not_benign from typed")
def prediction_table(spark, sf):
    out = D.prediction_table(view(spark, sf, "model_predictions"))
    return out.select(
        "row_index", "binary_prediction", "multiclass_label", "anomaly_flag", "attack_type", F.col("is_not_benign").cast("int").alias("is_not_benign")
    )


@query(
    "analysis_summary",
    ALERTS
    + """ select (select count(*) from typed) as flows_received, (select count(*) from al) as alerts_generated,
  (select count(*) from inc) as incidents_open,
  (select string_agg(attack_type || '=' || n, ';' order by attack_type) from (select attack_type, count(*) n from al group by 1)) as attack_type_counts""",
)
def analysis_summary(spark, sf):
    predictions = D.prediction_table(view(spark, sf, "model_predictions"))
    out = D.analysis_summary(predictions, headers(spark, sf))
    pairs = F.transform(F.map_entries("attack_type_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("attack_type_counts", F.array_join(pairs, ";"))


HEADER = f"""select incident_id, source_ip, destination_ip, sensor_id, {TEXT.format('ws')} as window_start,
  {TEXT.format('first_seen')} as first_seen, {TEXT.format('last_seen')} as last_seen, alert_count, suppressed_duplicates, attack_types,
  primary_attack_type, {LEVEL.format('severity_score')} as severity, severity_score"""


def header_rows(df):
    return df.select(
        "incident_id", "source_ip", "destination_ip", "sensor_id", stamp(F.col("window_start")).alias("window_start"),
        stamp(F.col("first_seen")).alias("first_seen"), stamp(F.col("last_seen")).alias("last_seen"), "alert_count",
        "suppressed_duplicates", F.array_join("attack_types", ",").alias("attack_types"), "primary_attack_type", "severity", "severity_score",
    )


@query("incidents", ALERTS + HEADER + " from inc")
def incidents(spark, sf):
    return header_rows(headers(spark, sf))


@query(
    "incident_alerts",
    ALERTS
    + """ select alert_id, 'incident-' || substr(sha1(source_ip || '|' || destination_ip || '|' || sensor || '|' ||
  strftime(ws, '%Y-%m-%dT%H:%M:%S+00:00')), 1, 14) as incident_id from ik""",
)
def incident_alerts(spark, sf):
    return I.with_incident(alerts(spark, sf)).select("alert_id", "incident_id")


@query("incident_upsert", ALERTS + HEADER + " from inc")
def incident_upsert(spark, sf):
    """Every critical and high alert is delivered a second time; the result is the same."""
    rows = alerts(spark, sf)
    return header_rows(I.upsert_incidents(rows.unionByName(rows.filter(F.col("severity").isin("critical", "high")))))


@query("active_incidents", ALERTS + HEADER + " from inc where last_seen >= timestamp '2024-01-01 00:40:00'")
def active_incidents(spark, sf):
    return header_rows(I.active_incidents(headers(spark, sf), "2024-01-01 01:40:00"))


@query(
    "correlation_lines",
    ALERTS
    + f""" select incident_id, incident_id || ' | ' || upper({LEVEL.format('severity_score')}) || ' | ' || source_ip || ' -> ' || destination_ip || ' | '
  || alert_count || ' alerts | ' || replace(attack_types, ',', ', ') as line from inc""",
)
def correlation_lines(spark, sf):
    return I.correlation_lines(headers(spark, sf))


TACTIC = f"tactic(phase, rank) as (values {values([(t, i) for i, t in enumerate(fixed.TACTICS)])})"


@query(
    "attack_progression",
    ALERTS
    + f""", {STEPS}, {TACTIC}, k as (select distinct source_ip, attack_type from al),
s as (select source_ip, attack_type, coalesce(step, 1) as step, coalesce(phase, 'Triage') as phase, tid, technique,
  coalesce(description, '{fixed.TRIAGE_STEP[4]}') as description from k left join steps on kind = attack_type),
d as (select * from s qualify row_number() over (partition by source_ip, phase, tid, description order by attack_type, step) = 1)
select source_ip, row_number() over (partition by source_ip order by coalesce(rank, 14), coalesce(tid, ''), attack_type, step) as step,
  phase, tid as technique_id, technique, description from d left join tactic using (phase)""",
)
def attack_progression(spark, sf):
    kinds = alerts(spark, sf).groupBy("source_ip").agg(F.sort_array(F.collect_set("attack_type")).alias("types"))
    steps = kinds.select("source_ip", F.explode(I.attack_progression(F.col("types"))).alias("s")).select("source_ip", "s.*")
    return steps.withColumn("step", F.col("step").cast("bigint"))


@query(
    "mitre_catalog",
    ALERTS
    + f""", {STEPS}, heads(kind, tactics, techniques) as (values {values([(k, listed(a), listed(b)) for k, _, a, b in fixed.PLAYBOOK])})
select attack_type, tactics, techniques, step, phase, tid as technique_id, technique, description, n as n_alerts
from (select attack_type, count(*) as n from al group by 1) a join heads on heads.kind = attack_type join steps on steps.kind = attack_type""",
)
def mitre_catalog(spark, sf):
    """Catalog rows of the attack types that occur, with their number of alerts."""
    n = alerts(spark, sf).groupBy("attack_type").agg(F.count(F.lit(1)).alias("n_alerts"))
    return n.join(F.broadcast(I.mitre_catalog(spark)), "attack_type")


@query(
    "mitre_playbook",
    with_views("predictions")
    + f""", {STEPS}, heads(kind, summary, tactics) as (values {values([(k, s, listed(a)) for k, s, a, _ in fixed.PLAYBOOK])})
select packet_id, predicted_label, coalesce(summary, '{fixed.TRIAGE_SUMMARY}') as summary, coalesce(tactics, '') as tactics,
  coalesce((select string_agg(description, ' ' order by step) from steps where steps.kind = predicted_label), '{fixed.TRIAGE_STEP[4]}') as steps
from predictions left join heads on heads.kind = predicted_label""",
)
def mitre_playbook(spark, sf):
    out = J.mitre_playbook(view(spark, sf, "predictions").select("packet_id", "predicted_label"), "predicted_label")
    return out.select(
        "packet_id", "predicted_label", "mitre.summary",
        F.array_join(F.transform("mitre.tactics", lambda t: F.concat_ws(":", t["id"], t["name"])), ";").alias("tactics"),
        F.array_join(F.transform("mitre.attack_steps", lambda s: s["description"]), " ").alias("steps"),
    )


@query(
    "flows_with_predictions",
    ALERTS
    + """, p as (select *, 1 as seq from typed where total_packets >= 5 union all by name
  select * replace ('Bot' as attack_type, 1 as binary_prediction), 2 as seq from typed where total_packets > 100),
q as (select * from p qualify row_number() over (partition by row_index order by seq desc) = 1)
select f.row_index, case when q.row_index is null then 'UNCLASSIFIED' when q.attack_type <> 'BENIGN' then 'NOT BENIGN' else 'BENIGN' end as binary_label,
  case when q.row_index is null then 'unclassified' when q.attack_type <> 'BENIGN' then q.attack_type else 'benign' end as attack_label,
  coalesce(q.binary_prediction, 0) as binary_prediction, coalesce(q.binary_confidence, 0) as binary_confidence,
  coalesce(q.anomaly_flag, 0) as anomaly_flag, al.severity
from flows f left join q using (row_index) left join al using (row_index)""",
)
def flows_with_predictions(spark, sf):
    """Small flows have no prediction; large ones have two, the later one says Bot."""
    flows = view(spark, sf, "flows").drop("attack_label")
    rows = scored(spark, sf)
    first = D.prediction_table(rows.filter("total_packets >= 5")).withColumn("seq", F.lit(1))
    later = D.prediction_table(rows.filter("total_packets > 100")).withColumns(
        {"attack_type": F.lit("Bot"), "binary_prediction": F.lit(1), "is_not_benign": F.lit(True), "seq": F.lit(2)}
    )
    raised = alerts(spark, sf).select("row_index", "severity", F.lit(1).alias("seq"))
    out = J.flows_with_predictions(flows, first.unionByName(later), raised, ["row_index"])
    return out.select("row_index", "binary_label", "attack_label", "binary_prediction", "binary_confidence", "anomaly_flag", "severity")


@query(
    "incident_status_overlay",
    ALERTS
    + """, ch as (select incident_id, case severity_score >= 95 when true then 'resolved' else 'acknowledged' end as status from inc
  where alert_count >= 2 or severity_score >= 95)
select incident_id, coalesce(status, 'open') as status from inc left join ch using (incident_id)""",
)
def incident_status_overlay(spark, sf):
    """Busy incidents are acknowledged, the worst dismissed later, and an invalid status is ignored."""
    rows = headers(spark, sf)
    changes = rows.filter("alert_count >= 2").select("incident_id", F.lit("acknowledged").alias("status"), F.lit(1).alias("seq"))
    changes = changes.unionByName(rows.filter("severity_score >= 95").select("incident_id", F.lit("dismissed").alias("status"), F.lit(2).alias("seq")))
    changes = changes.unionByName(rows.select("incident_id", F.lit("closed").alias("status"), F.lit(3).alias("seq")))
    stamped = changes.withColumn("changed_at", F.to_timestamp(F.lit("2024-01-01 02:00:00")))
    return J.status_overlay(rows, stamped).select("incident_id", "status")


@query(
    "request_stats",
    ALERTS
    + """ select (select count(distinct row_index // 50) from flows) as requests, (select count(*) from flows) as flows_received,
  (select count(*) from al) as alerts_generated, (select count(*) from inc) as incidents_open,
  (select count(*) from inc where severity_score >= 90) as open_critical, (select count(*) from inc where severity_score between 75 and 89) as open_high,
  (select count(*) from inc where severity_score between 55 and 74) as open_medium, (select count(*) from inc where severity_score < 55) as open_low""",
)
def request_stats(spark, sf):
    predictions = D.prediction_table(view(spark, sf, "model_predictions"))
    batches = predictions.groupBy(F.expr("row_index div 50").alias("batch")).agg(
        F.count(F.lit(1)).alias("flows"), F.count(F.when(F.col("attack_type") != "BENIGN", 1)).alias("alerts")
    )
    return A.request_stats(batches, headers(spark, sf))


# --- flow records ---------------------------------------------------------------------------


@query(
    "normalize_flow",
    with_views("flows")
    + """ select row_index, src_ip, case when sensor_id = ' ' then '192.168.1.1' else dst_ip end as dst_ip, src_port, cast(dst_port as bigint) as dst_port, protocol,
  case when total_packets < 5 then 0.0 else round(duration, 4) end as duration,
  case when tcp_flags = 'R' then null else total_packets end as total_packets, cast(0 as bigint) as bytes_src_to_dst,
  coalesce(tcp_flags, 'SYN') as tcp_flags, 'unknown' as label, case when tcp_flags = 'R' then 'total_packets' else '' end as rejected from flows""",
)
def normalize_flow(spark, sf):
    """Ports come as fractional text, some numbers are unreadable, some fields missing."""
    rows = view(spark, sf, "flows").select(
        "row_index", "src_ip", F.when(F.col("sensor_id") != " ", F.col("dst_ip")).alias("dst_ip"),
        F.concat(F.col("src_port").cast("string"), F.lit(".9")).alias("src_port"), "dst_port", F.lower("protocol").alias("protocol"),
        F.when(F.col("total_packets") >= 5, F.col("duration")).alias("duration"),
        F.when(F.col("tcp_flags").eqNullSafe("R"), "many").otherwise(F.col("total_packets").cast("string")).alias("total_packets"),
        "tcp_flags", "received_at",
    )
    out = P.normalize_flow(rows, F.col("received_at").cast("string"))
    return out.select(
        "row_index", "src_ip", "dst_ip", F.col("src_port").cast("int").alias("src_port"), "dst_port", "protocol",
        F.round("duration", 4).alias("duration"), F.col("total_packets").cast("int").alias("total_packets"), "bytes_src_to_dst", "tcp_flags", "label",
        F.array_join("rejected", ",").alias("rejected"),
    )


@query(
    "flatten_features",
    with_views("flows")
    + f""" select row_index, case when total_packets > 50 then 8080 else dst_port end as dst_port,
  case when total_packets > 10 then duration * 2 end as extra, {TEXT.format('received_at')} as at from flows""",
)
def flatten_features(spark, sf):
    inner = F.struct(F.when(F.col("total_packets") > 50, 8080).alias("dst_port"), (F.col("duration") * 2).alias("extra"))
    rows = view(spark, sf, "flows").withColumn("model_features", F.when(F.col("total_packets") > 10, inner))
    return P.flatten_features(rows).select("row_index", "dst_port", "extra", stamp(F.col("timestamp")).alias("at"))


@query(
    "align_features",
    with_views("flows")
    + """ select row_index, src_ip, cast(dst_port as double) as dst_port, duration, 0.0::double as missing_one, 0.0::double as tcp_flags from flows""",
)
def align_features(spark, sf):
    rows = view(spark, sf, "flows")
    return P.align_features(rows, ["dst_port", "duration", "missing_one", "tcp_flags"], ["row_index", "src_ip"])


@query(
    "parse_timestamp",
    f"""select event_id, case event_type when 'signup' then '2024-02-01 00:00:00.000000' when 'error' then '2024-02-01 00:00:00.000000'
  when 'view' then {TEXT.format('ts - interval 2 hours')} else {TEXT.format('ts')} end as at from events""",
)
def parse_timestamp(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = (
        F.when(F.col("event_type") == "signup", " ").when(F.col("event_type") == "error", "yesterday")
        .when(F.col("event_type") == "view", F.concat(text, F.lit("+02:00"))).when(F.col("event_type") == "click", F.concat(text, F.lit("Z"))).otherwise(text)
    )
    late = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    return rows.select("event_id", stamp(parse_time(raw, late)).alias("at"))


@query("null_or_blank_default", with_views("flows") + " select row_index, case when trim(sensor_id) = '' then 'unspecified' else sensor_id end as sensor_id from flows")
def null_or_blank_default(spark, sf):
    return view(spark, sf, "flows").select("row_index", default_text(F.col("sensor_id"), F.lit("unspecified")).alias("sensor_id"))


@query("severity_filter", ALERTS + " select alert_id, source_ip, attack_type, severity from al where severity in ('critical', 'high')")
def severity_filter(spark, sf):
    return P.severity_filter(alerts(spark, sf), ["critical", "high"], ["alert_id", "source_ip", "attack_type", "severity"])


def json_batches(spark, sf) -> DataFrame:
    """Flow rows packed into JSON payloads of 50 flows."""
    rows = view(spark, sf, "flows").withColumn("batch", F.expr("row_index div 50"))
    fields = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "total_packets"]
    packed = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("row_index", *fields))).alias("flows"))
    return packed.select("batch", F.size("flows").alias("n"), F.to_json(F.struct("flows", F.lit(10).alias("correlation_window_minutes"))).alias("payload"))


@query(
    "flow_batch_json",
    with_views("flows")
    + """ select row_index // 50 as batch, 10 as window_minutes, cast(row_index % 50 as int) as row_index, src_ip, dst_ip,
  cast(dst_port as varchar) as dst_port, protocol, cast(total_packets as varchar) as total_packets from flows""",
)
def flow_batch_json(spark, sf):
    out = S.flow_batches(json_batches(spark, sf), ["batch"])
    return out.select("batch", "window_minutes", "row_index", "src_ip", "dst_ip", "dst_port", "protocol", "total_packets")


@query(
    "batch_validate",
    with_views("flows")
    + """, b as (select row_index // 50 as batch, max(total_packets) as m from flows group by 1)
select batch, case when m > 300 then '''flows'' must be a JSON array.' when m > 200 then '''flows'' must contain at least one entry.'
  when m > 150 then 'Batch too large. Maximum 60 flows per request.' end as reason from b""",
)
def batch_validate(spark, sf):
    """Batches with very large flows are broken in three ways before the check."""
    top = view(spark, sf, "flows").groupBy(F.expr("row_index div 50").alias("batch")).agg(F.max("total_packets").alias("m"))

    doubled = F.concat(F.lit('{"flows":['), F.expr("substring(get_json_object(payload, '$.flows'), 2, length(get_json_object(payload, '$.flows')) - 2)"),
                       F.lit(","), F.expr("substring(get_json_object(payload, '$.flows'), 2)"), F.lit("}"))
    broken = (
        F.when(F.col("m") > 300, F.lit('{"flows": {"a": 1}}')).when(F.col("m") > 200, F.lit('{"flows": []}')).when(F.col("m") > 150, doubled)
        .otherwise(F.col("payload"))
    )
    rows = json_batches(spark, sf).join(top, "batch").withColumn("payload", broken)
    return S.batch_validate(rows, limit=60).select("batch", "reason")
