"""Views of the supplied tables as packets, predictions, flow records and labelled features.

The same SELECT text runs on Spark and on the checking engine; only the time and JSON
pieces differ between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EPOCH = 1704067200000000

SPARK = {
    "parsed": "{events} lateral view inline(array(named_struct('cts', "
    f"timestamp_micros({_EPOCH} + (unix_micros(cast(ts as timestamp)) - {_EPOCH}) div 720), "
    "'k', cast(get_json_object(props, '$.k') as int)))) parsed as cts, k",
    "ship": "unix_seconds(cast(l_shipdate as timestamp))",
}
DUCK = {
    "parsed": f"(select *, make_timestamp({_EPOCH} + (epoch_us(ts) - {_EPOCH}) // 720) as cts, "
    "cast(json_extract_string(props, '$.k') as int) as k from {events})",
    "ship": "epoch_us(l_shipdate) // 1000000",
}

_ROW_ID = """concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
  cast(l_suppkey as string), cast(cast(l_quantity as int) as string), cast({ship} as string))"""

# `parsed` holds time and k worked out once per row: on Spark behind a one-row generator,
# which keeps the optimiser from copying the JSON parsing into every later expression.
_EVENT = """select event_id, cts as ts, k, user_id, event_type, value,
  concat('192.168.1.', cast(user_id % 8 as string)) as cip, 40000 + cast(user_id % 2 as int) as cport,
  concat('10.0.0.', cast(k % 4 as string)) as sip,
  case k % 4 when 0 then 22 when 1 then 80 when 2 then 443 else 53 end as sport,
  case when k % 4 = 3 then 'UDP' else 'TCP' end as protocol,
  40 + cast(floor(value * 3) as int) as pkt_len, event_id % 3 = 0 as rev,
  case event_type when 'error' then 'DDoS' when 'click' then 'PortScan' when 'purchase' then 'WebAttack_XSS'
    when 'signup' then 'FTP-Patator' else 'BENIGN' end as kind,
  round(cast(0.55 as double) + (k % 45) / cast(100 as double), 3) as confidence
from {parsed}"""

_PACKET = """select event_id as packet_id, ts,
  case when rev then sip else cip end as src_ip, case when rev then cip else sip end as dst_ip,
  case when rev then sport else cport end as src_port, case when rev then cport else sport end as dst_port,
  protocol, pkt_len,
  case when protocol = 'TCP' then case event_type when 'error' then 'R' when 'click' then 'PA'
    when 'purchase' then 'A' when 'view' then 'FA' else 'S' end end as tcp_flags,
  case when protocol = 'TCP' then 20 else 8 end as header_len,
  case when protocol = 'TCP' then 1000 + cast(event_id % 64 as int) * 512 end as window_size,
  case when protocol = 'TCP' and event_type = 'click' then pkt_len - 40 else 0 end as payload_len,
  user_id, event_type, value, k, kind, confidence
from (""" + _EVENT + ") e"

VIEWS = {
    "predictions": """select event_id as packet_id, ts, cip as src_ip, sip as dst_ip, sport as dst_port, protocol,
  kind as predicted_label, confidence from (""" + _EVENT + ") e",
    "packets": """select packet_id, ts, src_ip, dst_ip, src_port, dst_port, protocol, pkt_len, tcp_flags, header_len,
  window_size, payload_len from (""" + _PACKET + ") p",
    "flows": """select packet_id as row_index, ts as received_at, src_ip, dst_ip, src_port, dst_port, protocol,
  cast(0.1 as double) + k / cast(10 as double) as duration,
  cast(floor(value) as int) as total_packets, cast(pkt_len * cast(floor(value) as int) as bigint) as total_bytes,
  cast(floor(value) as int) / (cast(0.1 as double) + k / cast(10 as double)) as packet_rate,
  pkt_len * cast(floor(value) as int) / (cast(0.1 as double) + k / cast(10 as double)) as byte_rate,
  cast(pkt_len as double) as avg_packet_size,
  tcp_flags, kind as attack_label, case when user_id % 2 = 0 then 'simulator' else 'network' end as mode,
  case when user_id % 5 = 0 then ' ' else concat('sensor-', cast(user_id % 3 as string)) end as sensor_id
from (""" + _PACKET + ") p",
    "model_predictions": """select event_id as row_index, cast(case when event_type <> 'view' then 1 else 0 end as int)
  as binary_prediction, confidence as binary_confidence, kind as multiclass_label,
  confidence as multiclass_confidence, cast(case when value > 100 then 1 else 0 end as int) as anomaly_flag,
  value / cast(200 as double) - cast(0.25 as double) as anomaly_score
from (""" + _EVENT + ") e",
    "features": "select " + _ROW_ID + """ as row_id,
  case when l_quantity = 50 and l_linenumber = 1 then 'Heartbleed' when l_returnflag = 'N' then 'BENIGN'
    when l_returnflag = 'A' and l_linestatus = 'F' then 'DDoS' when l_returnflag = 'A' then ' PortScan '
    when l_linestatus = 'F' then 'Web Attack - XSS' else 'Web Attack - Sql Injection' end as label,
  concat('file', cast(l_linenumber % 4 as string), '.csv') as source_file, 'lineitem' as dataset,
  cast(l_quantity as double) as f_packets, cast(l_extendedprice as double) as f_bytes,
  case when l_discount = 0 then cast('Infinity' as double) when l_tax = 0 then cast(null as double)
    else l_extendedprice / l_discount end as f_rate
from {lineitem}""",
    "scored": "select row_id, true_label, case when pk % 10 < 8 then true_label when pk % 10 = 8 then 'BENIGN' else 'DDoS' end as predicted_label, probability from (select " + _ROW_ID + """ as row_id,
  case when l_returnflag = 'N' then 'BENIGN' when l_returnflag = 'A' and l_linestatus = 'F' then 'DDoS'
    when l_returnflag = 'A' then 'PortScan' when l_linestatus = 'F' then 'WebAttack_XSS'
    else 'WebAttack_SQLInjection' end as true_label, l_partkey as pk,
  ((l_partkey * 7 + l_suppkey * 13) % 1000) / cast(1000 as double) as probability
from {lineitem}) s""",
}


def _filled(name: str, dialect: dict, tables: dict) -> str:
    pieces = {k: v.format(**tables) if k == "parsed" else v for k, v in dialect.items()}
    return VIEWS[name].format(**pieces, **tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the parquet tables in a folder."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("events", "lineitem")}
    return spark.sql(_filled(name, SPARK, tables))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(*names: str) -> str:
    """WITH clause holding the views, for the checking engine."""
    tables = {"events": "events", "lineitem": "lineitem"}
    parts = [f"{n} as ({_filled(n, DUCK, tables)})" for n in names]
    return "with " + ",\n".join(parts)
