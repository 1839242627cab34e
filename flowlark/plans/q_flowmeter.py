"""Flow metering queries over the packets view, with an idle timeout of 30 s."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.operators import flowmeter as M
from flowlark.plans.registry import query
from flowlark.sources.tables import view, with_views

# Whole-tuple windows, as plain as they can be said.
KEYED = (
    with_views("packets")
    + """, k as (select *, (src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port)) as dir, epoch_us(ts) as us from packets),
k2 as (select *, case when dir then src_ip else dst_ip end as ip1, case when dir then src_port else dst_port end as port1,
  case when dir then dst_ip else src_ip end as ip2, case when dir then dst_port else src_port end as port2 from k)
"""
)
ASSIGNED = (
    KEYED
    + """, l as (select *, us - lag(us) over (partition by ip1, port1, ip2, port2, protocol order by us, packet_id) as g from k2),
f as (select *, sum(case when g is null or g >= 30000000 then 1 else 0 end) over (partition by ip1, port1, ip2, port2, protocol order by us, packet_id) as fno from l),
pk as (select *, first_value(us) over w as flow_start, dir = first_value(dir) over w as fwd, first_value(src_ip) over w as fsrc, first_value(dst_ip) over w as fdst,
  first_value(src_port) over w as fsport, first_value(dst_port) over w as fdport,
  us - lag(us) over w as iat from f window w as (partition by ip1, port1, ip2, port2, protocol, fno order by us, packet_id)),
pd as (select *, us - lag(us) over (partition by ip1, port1, ip2, port2, protocol, fno, fwd order by us, packet_id) as diat from pk)
"""
)
FLOWS = (
    ASSIGNED
    + """, b as (select *, sum(case when diat > 1000000 then 1 else 0 end) over (partition by ip1, port1, ip2, port2, protocol, fno, fwd order by us, packet_id) as bno,
  sum(case when iat > 5000000 then 1 else 0 end) over (partition by ip1, port1, ip2, port2, protocol, fno order by us, packet_id) as ano from pd),
bulk1 as (select ip1, port1, ip2, port2, protocol, fno, fwd, bno, count(*) as n, sum(pkt_len) as yy, max(us) - min(us) as d from b group by all having n >= 4 and d > 0),
bulk as (select ip1, port1, ip2, port2, protocol, fno, count(*) filter (fwd) as fn, sum(n) filter (fwd) as fp, sum(yy) filter (fwd) as fb, sum(d) filter (fwd) as fd,
  count(*) filter (not fwd) as bn, sum(n) filter (not fwd) as bp, sum(yy) filter (not fwd) as bb, sum(d) filter (not fwd) as bd from bulk1 group by all),
act0 as (select ip1, port1, ip2, port2, protocol, fno, ano, max(us) - min(us) as d from b group by all),
act1 as (select *, ano = max(ano) over (partition by ip1, port1, ip2, port2, protocol, fno) as lastone from act0),
act as (select ip1, port1, ip2, port2, protocol, fno, avg(d) as am, stddev_samp(d) as asd, max(d) as ax, min(d) as an from act1 where d > 0 or not lastone group by all),
a0 as (select ip1, port1, ip2, port2, protocol, fno, flow_start, any_value(fsrc) as src_ip, any_value(fdst) as dst_ip, any_value(fsport) as src_port, any_value(fdport) as dst_port,
  greatest(max(us) - flow_start, 1) as dur, count(*) as n, sum(pkt_len) as yy, count(*) filter (fwd) as nf, count(*) filter (not fwd) as nb,
  coalesce(sum(pkt_len) filter (fwd), 0) as yf, coalesce(sum(pkt_len) filter (not fwd), 0) as yb,
  max(pkt_len) filter (fwd) as fx, min(pkt_len) filter (fwd) as fm, avg(pkt_len) filter (fwd) as fa, stddev_samp(pkt_len) filter (fwd) as fs,
  max(pkt_len) filter (not fwd) as bx, min(pkt_len) filter (not fwd) as bm, avg(pkt_len) filter (not fwd) as ba, stddev_samp(pkt_len) filter (not fwd) as bs,
  min(pkt_len) as lm, max(pkt_len) as lx, avg(pkt_len) as la, stddev_samp(pkt_len) as ls, var_samp(pkt_len) as lv,
  avg(iat) as ia, stddev_samp(iat) as isd, max(iat) as ix, min(iat) as im,
  max(us) filter (fwd) - min(us) filter (fwd) as ft, avg(diat) filter (fwd) as fia, stddev_samp(diat) filter (fwd) as fis, max(diat) filter (fwd) as fix, min(diat) filter (fwd) as fim,
  max(us) filter (not fwd) - min(us) filter (not fwd) as bt, avg(diat) filter (not fwd) as bia, stddev_samp(diat) filter (not fwd) as bis, max(diat) filter (not fwd) as bix, min(diat) filter (not fwd) as bim,
  count(*) filter (fwd and tcp_flags like '%P%') as pf, count(*) filter (not fwd and tcp_flags like '%P%') as pb,
  count(*) filter (fwd and tcp_flags like '%U%') as uf, count(*) filter (not fwd and tcp_flags like '%U%') as ub,
  coalesce(sum(header_len) filter (fwd), 0) as hf, coalesce(sum(header_len) filter (not fwd), 0) as hb,
  arg_min(window_size, us * 1000000::hugeint + packet_id) filter (fwd and window_size is not null) as wf,
  arg_min(window_size, us * 1000000::hugeint + packet_id) filter (not fwd and window_size is not null) as wb,
  count(*) filter (tcp_flags like '%F%') as c_f, count(*) filter (tcp_flags like '%S%') as c_s, count(*) filter (tcp_flags like '%R%') as c_r,
  count(*) filter (tcp_flags like '%P%') as c_p, count(*) filter (tcp_flags like '%A%') as c_a, count(*) filter (tcp_flags like '%U%') as c_u,
  count(*) filter (tcp_flags like '%C%') as c_c, count(*) filter (tcp_flags like '%E%') as c_e,
  coalesce(string_agg(distinct tcp_flags, ',' order by tcp_flags), 'NONE') as tcp_flags,
  count(*) filter (fwd and payload_len > 0) as dataf, coalesce(min(header_len) filter (fwd and header_len > 0), 0) as mh,
  1 + count(*) filter (iat > 1000000) as sub, avg(iat) filter (iat > 5000000) as da, stddev_samp(iat) filter (iat > 5000000) as dsd,
  max(iat) filter (iat > 5000000) as dx, min(iat) filter (iat > 5000000) as dm from b group by ip1, port1, ip2, port2, protocol, fno, flow_start),
fl as (select a0.*, bulk.* exclude (ip1, port1, ip2, port2, protocol, fno), act.* exclude (ip1, port1, ip2, port2, protocol, fno) from a0
  left join bulk using (ip1, port1, ip2, port2, protocol, fno) left join act using (ip1, port1, ip2, port2, protocol, fno))
"""
)

BULK = {d: [f"case when coalesce({d}n, 0) = 0 then 0 else {x} end" for x in (f"{d}b / {d}n::double", f"{d}p / {d}n::double", f"{d}b / ({d}d / 1e6)")] for d in "fb"}
FORMULAS = [
    "dst_port", "dur", "nf", "nb", "yf", "yb", "fx", "fm", "fa", "fs", "bx", "bm", "ba", "bs", "yy / (dur / 1e6)", "n / (dur / 1e6)",
    "ia", "isd", "ix", "im", "ft", "fia", "fis", "fix", "fim", "bt", "bia", "bis", "bix", "bim", "pf", "pb", "uf", "ub", "hf", "hb",
    "nf / (dur / 1e6)", "nb / (dur / 1e6)", "lm", "lx", "la", "ls", "lv", "c_f", "c_s", "c_r", "c_p", "c_a", "c_u", "c_c", "c_e",
    "nb / nf::double", "yy / n::double", "fa", "ba", "hf", *BULK["f"], *BULK["b"],
    "nf / sub::double", "yf / sub::double", "nb / sub::double", "yb / sub::double", "coalesce(wf, -1)", "coalesce(wb, -1)", "dataf", "mh",
    "am", "asd", "ax", "an", "da", "dsd", "dx", "dm",
]
assert len(FORMULAS) == len(fixed.FLOW_FEATURES)
WHO = "src_ip, dst_ip, src_port, protocol, flow_start"


def spread(name: str) -> int | None:
    """Places to compare time deviations at, whose last digits depend on the order of adding."""
    return 2 if name.endswith("Std") and name.startswith(("Flow", "Fwd IAT", "Bwd IAT", "Active", "Idle")) else None


def feature_sql(names: list[str]) -> str:
    picked = []
    for n in names:
        value = f"coalesce({FORMULAS[fixed.FLOW_FEATURES.index(n)]}, 0)::double"
        places = spread(n)
        text = f"printf('%.6f', {value})::double" if places is None else f"round({value}, {places})"
        picked.append(f'{text} as "{n}"')
    return FLOWS + f" select {WHO}, " + ", ".join(picked) + " from fl"


def shown(names: list[str], prefix: str = "") -> list:
    columns = [(F.col(f"{prefix}`{n}`"), n) for n in names]
    return [(c if spread(n) is None else F.round(c, spread(n))).alias(n) for c, n in columns]


def features(spark, sf, names):
    out = M.flow_features(view(spark, sf, "packets"), idle_timeout=30.0)
    return out.select("src_ip", "dst_ip", "src_port", "protocol", F.unix_micros("flow_start").alias("flow_start"), *shown(names))


def between(first: str, last: str) -> list[str]:
    names = fixed.FLOW_FEATURES
    return names[names.index(first) : names.index(last) + 1]


VOLUME = between("Destination Port", "Total Length of Bwd Packets") + ["Flow Bytes/s", "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s", "Down/Up Ratio", "Average Packet Size"]
LENGTHS = between("Fwd Packet Length Max", "Bwd Packet Length Std") + between("Min Packet Length", "Packet Length Variance") + ["Avg Fwd Segment Size", "Avg Bwd Segment Size"]
IATS = between("Flow IAT Mean", "Bwd IAT Min")
FLAG_NAMES = between("Fwd PSH Flags", "Bwd URG Flags") + between("FIN Flag Count", "ECE Flag Count")
HEADERS = ["Fwd Header Length", "Bwd Header Length", "Fwd Header Length.1"] + between("Init_Win_bytes_forward", "min_seg_size_forward")
BULKS = between("Fwd Avg Bytes/Bulk", "Bwd Avg Bulk Rate")
SUBFLOWS = between("Subflow Fwd Packets", "Subflow Bwd Bytes")
ACTIVES = between("Active Mean", "Idle Min")


@query("flow_key", KEYED + " select packet_id, ip1 as k_ip1, port1 as k_port1, ip2 as k_ip2, port2 as k_port2, protocol from k2")
def flow_key(spark, sf):
    return M.flow_key(view(spark, sf, "packets")).select("packet_id", *M.KEY)


@query("flow_assign", ASSIGNED + " select packet_id, flow_start, cast(fwd as int) as forward, iat, diat as side_iat from pd")
def flow_assign(spark, sf):
    out = M.packet_shares(view(spark, sf, "packets"), idle_timeout=30.0)
    return out.select("packet_id", "flow_start", F.col("forward").cast("int").alias("forward"), "iat", "side_iat")


@query("flow_volume", feature_sql(VOLUME))
def flow_volume(spark, sf):
    return features(spark, sf, VOLUME)


@query("length_stats", feature_sql(LENGTHS))
def length_stats(spark, sf):
    return features(spark, sf, LENGTHS)


@query("iat_stats", feature_sql(IATS))
def iat_stats(spark, sf):
    return features(spark, sf, IATS)


@query("tcp_flag_counts", feature_sql(FLAG_NAMES).replace(" from fl", ", tcp_flags from fl"))
def tcp_flag_counts(spark, sf):
    out = M.flow_records(view(spark, sf, "packets"), idle_timeout=30.0)
    return out.select(
        "src_ip", "dst_ip", "src_port", "protocol", F.unix_micros("flow_start").alias("flow_start"),
        *shown(FLAG_NAMES, "model_features."), "tcp_flags",
    )


@query("header_window", feature_sql(HEADERS))
def header_window(spark, sf):
    return features(spark, sf, HEADERS)


@query("bulk_stats", feature_sql(BULKS))
def bulk_stats(spark, sf):
    return features(spark, sf, BULKS)


@query("active_idle", feature_sql(ACTIVES))
def active_idle(spark, sf):
    return features(spark, sf, ACTIVES)


@query("subflows", feature_sql(SUBFLOWS))
def subflows(spark, sf):
    return features(spark, sf, SUBFLOWS)


@query("flow_feature_table", feature_sql(fixed.FLOW_FEATURES))
def flow_feature_table(spark, sf):
    return features(spark, sf, fixed.FLOW_FEATURES)


@query(
    "flow_summary_records",
    FLOWS
    + """ select src_ip, dst_ip, src_port, dst_port, protocol, printf('%.4f', dur / 1e6)::double as duration, n as total_packets, cast(yy as bigint) as total_bytes, nf as packets_src_to_dst,
  nb as packets_dst_to_src, cast(yf as bigint) as bytes_src_to_dst, cast(yb as bigint) as bytes_dst_to_src, printf('%.4f', n / (dur / 1e6))::double as packet_rate,
  printf('%.4f', yy / (dur / 1e6))::double as byte_rate, printf('%.4f', yy / n::double)::double as avg_packet_size, tcp_flags, 'unknown' as label from fl""",
)
def flow_summary_records(spark, sf):
    return M.flow_records(view(spark, sf, "packets"), idle_timeout=30.0).drop("flow_start", "last_seen", "model_features")
