"""Series, reports and newest-N views over flow records and raw events."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlark.functions.expr import stamp
from flowlark.operators import alerts as D
from flowlark.operators import clean as P
from flowlark.operators import profile as A
from flowlark.operators import timeseries as R
from flowlark.plans.q_alerts import ALERTS, alerts
from flowlark.plans.q_correlate import TEXT
from flowlark.plans.registry import query
from flowlark.sources.tables import view, with_views

NOW = "2024-01-01 00:40:30.5"  # in the compressed hour
LATE = "2024-01-28 15:20:10"  # in the raw month

TRAFFIC = """with traffic as (select event_id as row_index, ts as received_at, cast(floor(value) as int) as total_packets,
  case event_type when 'view' then 'Benign' when 'signup' then null else event_type end as attack_label from events)"""
SERIES = """ select i as position, strftime(b, '{label}') as x, cast(coalesce(y, 0) as bigint) as y
from (select i, date_trunc('{unit}', timestamp '{now}') - to_{unit}s(cast({n} - 1 - i as bigint)) as b from range({n}) t(i)) s
left join (select date_trunc('{unit}', received_at) as b, sum(total_packets) as y from {source} group by 1) c using (b)"""


def traffic(spark, sf):
    """Raw events as flow records over a month."""
    kind = F.when(F.col("event_type") == "view", "Benign").when(F.col("event_type") != "signup", F.col("event_type"))
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("row_index"), F.col("ts").cast("timestamp").alias("received_at"), F.floor("value").cast("int").alias("total_packets"),
        kind.alias("attack_label"),
    )


@query("packets_per_second", with_views("flows") + SERIES.format(unit="second", n=60, now=NOW, label="%H:%M:%S", source="flows"))
def packets_per_second(spark, sf):
    return R.packets_per_second(view(spark, sf, "flows"), NOW)


@query(
    "poll_activity",
    with_views("flows")
    + """, c as (select 49 - (epoch_us(timestamp '2024-01-01 00:40:30') - epoch_us(received_at)) // 2500000 as i, sum(total_packets) as y from flows
  where received_at <= timestamp '2024-01-01 00:40:30' and received_at >= timestamp '2024-01-01 00:40:30' - interval 122.5 seconds group by 1)
select t.i as position, strftime(timestamp '2024-01-01 00:40:30' - to_microseconds((49 - t.i) * 2500000), '%H:%M:%S') as x,
  cast(coalesce(y, 0) as bigint) as y from range(50) t(i) left join c using (i)""",
)
def poll_activity(spark, sf):
    return R.poll_activity(view(spark, sf, "flows"), NOW, 2.5)


@query("packets_per_minute", with_views("flows") + SERIES.format(unit="minute", n=60, now=NOW, label="%H:%M", source="flows"))
def packets_per_minute(spark, sf):
    return R.packets_per_minute(view(spark, sf, "flows"), NOW)


@query("packets_per_hour", TRAFFIC + SERIES.format(unit="hour", n=24, now=LATE, label="%H:00", source="traffic"))
def packets_per_hour(spark, sf):
    return R.packets_per_hour(traffic(spark, sf), LATE)


@query("packets_per_day", TRAFFIC + SERIES.format(unit="day", n=7, now=LATE, label="%Y-%m-%d", source="traffic"))
def packets_per_day(spark, sf):
    return R.packets_per_day(traffic(spark, sf), LATE)


TIDY = "case when upper(attack_label) = 'BENIGN' then 'benign' else coalesce(attack_label, 'unknown') end"


@query("attack_counts", TRAFFIC + f" select {TIDY} as label, count(*) as n_flows from traffic group by 1")
def attack_counts(spark, sf):
    return R.attack_counts(traffic(spark, sf))


@query("attack_counts_no_benign", TRAFFIC + f" select {TIDY} as label, count(*) as n_flows from traffic where {TIDY} <> 'benign' group by 1")
def attack_counts_no_benign(spark, sf):
    return R.attack_counts(traffic(spark, sf), with_benign=False)


@query(
    "date_range_filter",
    TRAFFIC + f" select row_index, {TEXT.format('received_at')} as at from traffic where received_at >= '2024-01-05' and received_at < '2024-01-13'",
)
def date_range_filter(spark, sf):
    rows = P.date_range(traffic(spark, sf), "received_at", "2024-01-05", "2024-01-12")
    return rows.select("row_index", stamp(F.col("received_at")).alias("at"))


DAILY = f""", daily as (select strftime(received_at, '%Y-%m-%d') as day, 'flows' as kind, '' as key, count(*) as value from chosen group by 1
union all select strftime(received_at, '%Y-%m-%d'), 'label', {TIDY}, count(*) from chosen group by 1, 3
union all select day, 'hour', printf('%02d:00', cast(h as int)), cast(coalesce(sum(total_packets), 0) as bigint) from
  (select distinct strftime(received_at, '%Y-%m-%d') as day from chosen) d cross join range(24) t(h)
  left join chosen on strftime(received_at, '%Y-%m-%d') = day and hour(received_at) = h group by 1, 3)
"""


@query("daily_report", TRAFFIC + ", chosen as (select * from traffic)" + DAILY + " select * from daily")
def daily_report(spark, sf):
    return R.daily_report(traffic(spark, sf))


def _series(unit, n, now, label, source, section):
    return f"select '{section}' as section, * from ({SERIES.format(unit=unit, n=n, now=now, label=label, source=source)})"


def charts(source, now, poll_us=3000000):
    second = f"date_trunc('second', timestamp '{now}')"
    return (
        f"""select 'packet_activity' as section, t.i as position, strftime({second} - to_microseconds((49 - t.i) * {poll_us}), '%H:%M:%S') as x,
  cast(coalesce(y, 0) as bigint) as y from range(50) t(i) left join (select 49 - (epoch_us({second}) - epoch_us(received_at)) // {poll_us} as i,
  sum(total_packets) as y from {source} where received_at <= {second} and received_at >= {second} - to_microseconds(49 * {poll_us}) group by 1) c using (i) union all by name """
        + " union all by name ".join(
            [
                _series("second", 60, now, "%H:%M:%S", source, "per_second"),
                _series("minute", 60, now, "%H:%M", source, "per_minute"),
                _series("hour", 24, now, "%H:00", source, "per_hour"),
                _series("day", 7, now, "%Y-%m-%d", source, "per_day"),
            ]
        )
        + f" union all by name select 'attack_counts' as section, 0 as position, {TIDY} as x, count(*) as y from {source} group by 3"
    )


@query(
    "report_bundle",
    TRAFFIC
    + ", chosen as (select * from traffic where received_at >= '2024-01-20' and received_at < '2024-01-29')"
    + DAILY
    + charts("chosen", LATE)
    + " union all by name select 'day ' || day || ' ' || kind as section, 0 as position, key as x, value as y from daily",
)
def report_bundle(spark, sf):
    return R.report_bundle(traffic(spark, sf), LATE, "2024-01-20", "2024-01-28")


@query(
    "alert_severity_counts",
    ALERTS
    + """ select count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high,
  count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from al""",
)
def alert_severity_counts(spark, sf):
    return R.alert_severity_counts(alerts(spark, sf))


@query(
    "alert_severity_from_text",
    ALERTS
    + """, w as (select count(*) filter (severity = 'critical' or attack_type = 'DDoS') as critical, count(*) filter (severity = 'high' or attack_type = 'DDoS') as high,
  0::bigint as medium, count(*) as n from al) select critical, high, medium, greatest(n - critical - high - medium, 0) as low from w""",
)
def alert_severity_from_text(spark, sf):
    return R.alert_severity_from_text(alerts(spark, sf).select(R.alert_line().alias("line")))


@query(
    "recent_n",
    with_views("flows") + " select row_index, mode, total_packets from flows qualify row_number() over (partition by mode order by received_at desc, row_index desc) <= 250",
)
def recent_n(spark, sf):
    return R.recent_n(view(spark, sf, "flows"), "feed").select("row_index", "mode", "total_packets")


@query(
    "mode_counters",
    ALERTS
    + """ select mode, count(*) as total_flows, count(*) filter (attack_type = 'BENIGN' and total_packets >= 5) as benign_count,
  count(*) filter (attack_type <> 'BENIGN' and total_packets >= 5) as not_benign_count from typed group by 1""",
)
def mode_counters(spark, sf):
    """Small flows are unclassified: they count in the total only."""
    rows = view(spark, sf, "flows").join(view(spark, sf, "model_predictions"), "row_index")
    label = F.when(F.col("total_packets") < 5, "UNCLASSIFIED").when(D.resolve_attack_type() == "BENIGN", "BENIGN").otherwise("NOT BENIGN")
    return A.mode_counters(rows.select("mode", label.alias("binary_label")))


def lines(spark, sf):
    rows = view(spark, sf, "flows").drop("attack_label").join(alerts(spark, sf).select("row_index", "attack_type", "severity"), "row_index", "left")
    rows = rows.withColumn("binary_label", F.when(F.col("attack_type").isNull(), "BENIGN").otherwise("NOT BENIGN"))
    return rows.withColumn("attack_label", F.coalesce("attack_type", F.lit("benign")))


FEED = """strftime(f.received_at, '%Y-%m-%d %H:%M:%S') || ' | ' || f.src_ip || ':' || f.src_port || ' -> ' || f.dst_ip || ':' || f.dst_port || ' | ' ||
  f.protocol || ' | packets=' || f.total_packets || ' | bytes=' || f.total_bytes || ' | duration=' || printf('%.2f', f.duration) || 's | ' ||
  case when al.attack_type is null then 'BENIGN' else 'NOT BENIGN' end || ' | ' || coalesce(al.attack_type, 'benign')"""
SUSPICIOUS = """strftime(received_at, '%Y-%m-%d %H:%M:%S') || ' | ' || src_port || ' | ' || dst_port || ' | ' || printf('%.2f', duration) || 's | ' ||
  total_bytes || ' bytes | ' || attack_type || ' | severity=' || severity"""
ALERT = """strftime(received_at, '%Y-%m-%dT%H:%M:%S.%f') || ' - ' || upper(severity) || ' ' || attack_type || ' from ' || source_ip || ' to ' || destination_ip"""


@query(
    "feed_lines",
    ALERTS
    + f""" select f.row_index, 'feed' as kind, {FEED} as line from flows f left join al using (row_index)
union all select row_index, 'suspicious', {SUSPICIOUS} from al union all select row_index, 'alert', {ALERT} from al""",
)
def feed_lines(spark, sf):
    rows = lines(spark, sf)
    at = F.col("received_at")
    feed = rows.select("row_index", F.lit("feed").alias("kind"), R.feed_line(at).alias("line"))
    bad = rows.filter(F.col("attack_type").isNotNull()).select("row_index", F.lit("suspicious").alias("kind"), R.suspicious_line(at).alias("line"))
    raised = alerts(spark, sf).select("row_index", F.lit("alert").alias("kind"), R.alert_line().alias("line"))
    return feed.unionByName(bad).unionByName(raised)


@query(
    "insight_context",
    ALERTS
    + f""", l as (select mode, row_index, received_at, {ALERT} as a, {SUSPICIOUS} as s from al
  qualify row_number() over (partition by mode order by received_at desc, row_index desc) <= 5)
select mode, string_agg(a, chr(10) order by received_at desc, row_index desc) as alerts,
  string_agg(s, chr(10) order by received_at desc, row_index desc) as suspicious from l group by 1""",
)
def insight_context(spark, sf):
    rows = lines(spark, sf).filter(F.col("attack_type").isNotNull())
    modes = rows.select("row_index", "mode", "received_at")
    raised = alerts(spark, sf).select("row_index", R.alert_line().alias("line")).join(modes, "row_index")
    bad = rows.select("row_index", "mode", "received_at", R.suspicious_line(F.col("received_at")).alias("line"))
    return R.insight_context(raised, bad)


@query(
    "insights_without_repeats",
    with_views("flows")
    + """ select row_index, mode, attack_label from (select *, lag(attack_label) over (partition by mode order by received_at, row_index) as p from flows)
where p is distinct from attack_label""",
)
def insights_without_repeats(spark, sf):
    rows = view(spark, sf, "flows").select("row_index", "mode", "received_at", "attack_label")
    return R.without_repeats(rows, "attack_label").select("row_index", "mode", "attack_label")


SNAP_NOW = "2024-01-01 00:59:30"


@query(
    "dashboard_snapshot",
    with_views("flows")
    + """, sim as (select * from flows where mode = 'simulator'), net as (select * from flows where mode = 'network')
"""
    + f"""select 'simulator' as mode, * from ({charts('sim', SNAP_NOW)}) union all by name select 'network' as mode, * from ({charts('net', SNAP_NOW)})
union all by name select mode, 'summary' as section, 0 as position, 'total_flows' as x, count(*) as y from flows group by 1
union all by name select mode, 'summary' as section, 1 as position, 'benign_count' as x, count(*) filter (attack_label = 'BENIGN') as y from flows group by 1
union all by name select mode, 'summary' as section, 2 as position, 'not_benign_count' as x, count(*) filter (attack_label <> 'BENIGN') as y from flows group by 1""",
)
def dashboard_snapshot(spark, sf):
    return R.dashboard_snapshot(view(spark, sf, "flows"), SNAP_NOW)
