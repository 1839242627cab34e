"""Sources, sinks and streams. Each query writes rows derived from the tables to the shared
folder and reads them back as files or as a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.functions.expr import stamp
from flowlark.plans.q_alerts import ALERTS, HEADER, alerts, header_rows
from flowlark.plans.q_correlate import GROUPS, TEXT, events
from flowlark.plans.q_flowmeter import feature_sql, shown
from flowlark.plans.q_profile import FILES, SPLIT, labelled
from flowlark.functions import fixed
from flowlark.operators import sampling as B
from flowlark.plans.registry import query
from flowlark.sources import flow_files as S
from flowlark.sources.tables import view, with_views
from flowlark.streaming import correlate as SC
from flowlark.streaming import flowmeter as SM
from flowlark.streaming import incidents as SI
from flowlark.streaming.run import drain_batches, drain_to_parquet, fresh_folder


@query(
    "ingest_csv",
    with_views("features")
    + """ select row_id, label, f_packets, f_bytes, case when source_file = 'file3.csv' then null else f_rate end as f_rate, 'cic' as dataset from features""",
)
def ingest_csv(spark, sf):
    """Two kinds of files in one folder: padded headers, and one without the rate column."""
    folder = fresh_folder(spark, "csv")
    rows = view(spark, sf, "features").select("row_id", "label", "f_packets", "f_bytes", "f_rate", "source_file")
    full = rows.filter("source_file <> 'file3.csv'").select("row_id", F.col("label").alias(" label"), "f_packets", F.col("f_bytes").alias(" f_bytes "), "f_rate")
    short = rows.filter("source_file = 'file3.csv'").select("row_id", "f_packets", "f_bytes", "label")
    for part in (full, short):
        part.write.mode("append").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    text, real = T.StringType(), T.DoubleType()
    kinds = T.StructType([T.StructField(n, t) for n, t in (("row_id", text), ("label", text), ("f_packets", real), ("f_bytes", real), ("f_rate", real))])
    return S.ingest_csv(spark, folder, "cic", kinds).select("row_id", "label", "f_packets", "f_bytes", "f_rate", "dataset")


@query("parquet_roundtrip", SPLIT + " select row_id, label, split from sp")
def parquet_roundtrip(spark, sf):
    folder = fresh_folder(spark, "splits")
    S.write_splits(B.temporal_split(labelled(spark, sf), FILES).select("row_id", "label", "split"), folder)
    parts = [S.read_split(spark, folder, name).select("row_id", "label", "split") for name in ("train", "valid", "test")]
    return reduce(DataFrame.unionByName, parts)


@query("csv_report_sink", GROUPS + " select src_ip, predicted_label, alert_count, avg_confidence, severity, tac as tactic from ev")
def csv_report_sink(spark, sf):
    folder = fresh_folder(spark, "report")
    columns = ["src_ip", "predicted_label", "alert_count", "avg_confidence", "severity", "tactic"]
    S.write_report(events(spark, sf).select(*columns), folder)
    return S.read_report(spark, folder, "src_ip string, predicted_label string, alert_count bigint, avg_confidence double, severity string, tactic string")


FILES_PER_PART = 4


def quarter(rows: DataFrame, ts: str) -> F.Column:
    """0 to 3: the quarter of the table's own time span that a row lies in; rows without a time are in the first."""
    span = rows.agg(F.min(F.unix_micros(ts)).alias("lo"), F.max(F.unix_micros(ts)).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    return F.coalesce(F.floor((F.unix_micros(ts) - F.lit(lo)) * 4 / F.lit(hi - lo + 1)), F.lit(0))


def staged(rows: DataFrame, ts: str, name: str) -> str:
    """All rows as files in time order: four writes of FILES_PER_PART files each."""
    folder = fresh_folder(rows.sparkSession, name)
    at = quarter(rows, ts)
    for k in range(4):
        rows.filter(at == k).repartition(FILES_PER_PART).write.mode("append").parquet(folder)
    return folder


@query("packet_stream_source", with_views("packets") + f" select packet_id, {TEXT.format('ts')} as at, src_ip, dst_port, pkt_len, tcp_flags from packets")
def packet_stream_source(spark, sf):
    folder = staged(view(spark, sf, "packets"), "ts", "packets")
    rows = drain_to_parquet(S.packet_stream(spark, folder, FILES_PER_PART), fresh_folder(spark, "out"), fresh_folder(spark, "checkpoint"))
    return rows.select("packet_id", stamp(F.col("ts")).alias("at"), "src_ip", "dst_port", "pkt_len", "tcp_flags")


@query(
    "correlate_stream",
    GROUPS + f" select src_ip, {TEXT.format('b')} as time_bucket, predicted_label, alert_count, avg_confidence, severity, mid as mitre_id from ev",
)
def correlate_stream(spark, sf):
    """As correlate_alerts, from a stream; one late closing row moves the watermark past all buckets."""
    rows = view(spark, sf, "predictions")
    closing = rows.limit(1).select(
        *[
            F.to_timestamp(F.lit("2024-01-01 01:50:00")).alias(c) if c == "ts" else F.lit("closing").alias(c) if c == "predicted_label" else F.col(c)
            for c in rows.columns
        ]
    )
    folder = staged(rows.unionByName(closing), "ts", "predictions")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_PART).parquet(folder)
    out = drain_to_parquet(SC.correlate_stream(stream), fresh_folder(spark, "out"), fresh_folder(spark, "checkpoint"))
    return out.select("src_ip", stamp(F.col("time_bucket")).alias("time_bucket"), "predicted_label", "alert_count", "avg_confidence", "severity", "mitre_id")


@query(
    "mode_counters_stream",
    with_views("flows")
    + """ select mode, count(*) as total_flows, count(*) filter (attack_label = 'BENIGN') as benign_count,
  count(*) filter (attack_label <> 'BENIGN') as not_benign_count from flows group by 1""",
)
def mode_counters_stream(spark, sf):
    label = F.when(F.col("attack_label") == "BENIGN", "BENIGN").otherwise("NOT BENIGN").alias("binary_label")
    rows = view(spark, sf, "flows").select("mode", "received_at", label)
    folder = staged(rows, "received_at", "flows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_PART).parquet(folder)
    out = fresh_folder(spark, "out")
    drain_batches(SC.counters_stream(stream), lambda batch, epoch: batch.write.mode("overwrite").parquet(out), fresh_folder(spark, "checkpoint"), "complete")
    return spark.read.parquet(out)


@query("incident_stream", ALERTS + HEADER + " from inc")
def incident_stream(spark, sf):
    """As incidents, from a stream in which the last quarter is delivered twice."""
    rows = alerts(spark, sf)
    folder = staged(rows, "timestamp", "alerts")
    rows.filter(quarter(rows, "timestamp") == 3).repartition(FILES_PER_PART).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_PART).parquet(folder)
    out = fresh_folder(spark, "out")
    SI.write_incident_updates(SI.incident_updates(stream), out, fresh_folder(spark, "checkpoint"))
    return header_rows(SI.current_incidents(spark, out))


@query("flow_meter_stream", feature_sql(fixed.FLOW_FEATURES))
def flow_meter_stream(spark, sf):
    """As flow_feature_table, from a stream of four parts and a final flush."""
    folder = staged(view(spark, sf, "packets"), "ts", "packets")
    out, state = fresh_folder(spark, "out"), fresh_folder(spark, "state")
    last = SM.meter_stream(S.packet_stream(spark, folder, FILES_PER_PART), out, state, fresh_folder(spark, "checkpoint"), idle_timeout=30.0)
    SM.flush(spark, out, state, last, idle_timeout=30.0)
    flows = spark.read.option("basePath", out).parquet(f"{out}/epoch=*")
    return flows.select("src_ip", "dst_ip", "src_port", "protocol", F.unix_micros("flow_start").alias("flow_start"), *shown(fixed.FLOW_FEATURES))
