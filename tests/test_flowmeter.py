"""Flow metering against a plain per-flow calculation, in batch and as a stream."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.operators import flowmeter as M
from flowlark.sources.flow_files import PACKETS, packet_stream
from flowlark.streaming import flowmeter as SM

START = 1_704_067_200_000_000


def make_packets(seed, n=600, hot=0.4, span=400.0):
    """Random packets over a few hosts; one 5-tuple gets a large share, times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < hot:
            a, b, proto = ("10.0.0.9", 5000), ("10.0.0.10", 80), "TCP"
        else:
            a, b = (f"10.0.0.{rng.randint(1, 3)}", rng.choice([80, 443])), (f"10.0.0.{rng.randint(1, 3)}", rng.choice([80, 5001]))
            proto = rng.choice(["TCP", "UDP"])
        if rng.random() < 0.4:
            a, b = b, a
        us = START + int(rng.choice([round(rng.uniform(0, span)), rng.uniform(0, span)]) * 1_000_000)
        tcp = proto == "TCP"
        rows.append(
            (i, us, a[0], b[0], a[1], b[1], proto, rng.randint(40, 1500), rng.choice(["S", "PA", "FA", "AU", "EC", "", None]) if tcp else None,
             rng.choice([0, 20, 24]) if tcp else 8, rng.choice([None, 100, 900, 65535]) if tcp else None, rng.choice([0, 0, 10]))
        )
    return rows


def frame(spark, rows):
    stamped = [(r[0], dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r[1]), *r[2:]) for r in rows]
    return spark.createDataFrame(stamped, PACKETS)


def spread(values):
    values = [float(v) for v in values]
    if not values:
        return dict(mean=0.0, std=0.0, var=0.0, max=0.0, min=0.0)
    var = float(np.var(values, ddof=1)) if len(values) > 1 else 0.0
    return dict(mean=float(np.mean(values)), std=var**0.5, var=var, max=max(values), min=min(values))


def runs(times, gap):
    out = [[0]]
    for i in range(1, len(times)):
        if times[i] - times[i - 1] > gap:
            out.append([])
        out[-1].append(i)
    return out


def plain_flows(rows, idle, active, quiet):
    tuples = {}
    for r in rows:
        ends = sorted([(r[2], r[4]), (r[3], r[5])])
        tuples.setdefault((*ends, r[6]), []).append(r)
    flows = {}
    for packets in tuples.values():
        packets.sort(key=lambda r: (r[1], r[0]))
        cuts = [0] + [i for i in range(1, len(packets)) if packets[i][1] - packets[i - 1][1] >= idle * 1e6] + [len(packets)]
        for a, b in zip(cuts, cuts[1:]):
            part = packets[a:b]
            name = (part[0][2], part[0][3], part[0][4], part[0][5], part[0][6], part[0][1])
            flows[name] = plain_features(part, active * 1e6, quiet * 1e6)
    return flows


def plain_features(part, active, quiet):
    first = part[0]
    times = [p[1] for p in part]
    gaps = list(np.diff(times))
    us = max(times[-1] - times[0], 1)
    sides = {"Fwd": [p for p in part if p[2:6] == first[2:6]]}
    sides["Bwd"] = [p for p in part if p not in sides["Fwd"]]
    f = {"Destination Port": first[5], "Flow Duration": us}
    f["Total Fwd Packets"], f["Total Backward Packets"] = len(sides["Fwd"]), len(sides["Bwd"])
    sums = {s: sum(p[7] for p in ps) for s, ps in sides.items()}
    f["Total Length of Fwd Packets"], f["Total Length of Bwd Packets"] = sums["Fwd"], sums["Bwd"]
    n, total = len(part), sum(p[7] for p in part)
    f["Flow Bytes/s"], f["Flow Packets/s"] = total / us * 1e6, n / us * 1e6
    for s, ps in sides.items():
        st = spread([p[7] for p in ps])
        for m in ("Max", "Min", "Mean", "Std"):
            f[f"{s} Packet Length {m}"] = st[m.lower()]
        f[f"Avg {s} Segment Size"] = st["mean"]
        own = [p[1] for p in ps]
        st = spread(np.diff(own)) if own else spread([])
        f[f"{s} IAT Total"] = own[-1] - own[0] if own else 0
        for m in ("Mean", "Std", "Max", "Min"):
            f[f"{s} IAT {m}"] = st[m.lower()]
        f[f"{s} PSH Flags"] = sum("P" in (p[8] or "") for p in ps)
        f[f"{s} URG Flags"] = sum("U" in (p[8] or "") for p in ps)
        f[f"{s} Header Length"] = sum(p[9] for p in ps)
        f[f"{s} Packets/s"] = len(ps) / us * 1e6
        bulks = [[ps[i] for i in run] for run in runs(own, quiet)] if own else []
        bulks = [b for b in bulks if len(b) >= 4 and b[-1][1] > b[0][1]]
        size, time = sum(p[7] for b in bulks for p in b), sum(b[-1][1] - b[0][1] for b in bulks)
        f[f"{s} Avg Bytes/Bulk"] = size / len(bulks) if bulks else 0
        f[f"{s} Avg Packets/Bulk"] = sum(map(len, bulks)) / len(bulks) if bulks else 0
        f[f"{s} Avg Bulk Rate"] = size / time * 1e6 if bulks else 0
        seen = [p[10] for p in ps if p[10] is not None]
        f[f"Init_Win_bytes_{'forward' if s == 'Fwd' else 'backward'}"] = seen[0] if seen else -1
        parts = 1 + sum(g > quiet for g in gaps)
        f[f"Subflow {s} Packets"], f[f"Subflow {s} Bytes"] = len(ps) / parts, sums[s] / parts
    f["Fwd Header Length.1"] = f["Fwd Header Length"]
    st = spread([p[7] for p in part])
    f.update({"Min Packet Length": st["min"], "Max Packet Length": st["max"], "Packet Length Mean": st["mean"],
              "Packet Length Std": st["std"], "Packet Length Variance": st["var"]})
    st = spread(gaps)
    for m in ("Mean", "Std", "Max", "Min"):
        f[f"Flow IAT {m}"] = st[m.lower()]
    for name, letter in (("FIN", "F"), ("SYN", "S"), ("RST", "R"), ("PSH", "P"), ("ACK", "A"), ("URG", "U"), ("CWE", "C"), ("ECE", "E")):
        f[f"{name} Flag Count"] = sum(letter in (p[8] or "") for p in part)
    f["Down/Up Ratio"] = len(sides["Bwd"]) / len(sides["Fwd"])
    f["Average Packet Size"] = total / n
    f["act_data_pkt_fwd"] = sum(p[11] > 0 for p in sides["Fwd"])
    heads = [p[9] for p in sides["Fwd"] if p[9] > 0]
    f["min_seg_size_forward"] = min(heads) if heads else 0
    spans = [times[r[-1]] - times[r[0]] for r in runs(times, active)]
    busy = spread(spans[:-1] + [d for d in spans[-1:] if d > 0])
    still = spread([g for g in gaps if g > active])
    for m in ("Mean", "Std", "Max", "Min"):
        f[f"Active {m}"], f[f"Idle {m}"] = busy[m.lower()], still[m.lower()]
    return f


def by_name(rows):
    return {(r["src_ip"], r["dst_ip"], r["src_port"], r["Destination Port"], r["protocol"], r["start_us"]): r for r in rows}


def check(flows, want):
    got = by_name(flows.withColumn("start_us", F.unix_micros("flow_start")).collect())
    assert set(got) == set(want)
    for name, features in want.items():
        assert set(features) == set(fixed.FLOW_FEATURES)
        for feature, value in features.items():
            assert got[name][feature] == pytest.approx(float(value), rel=1e-9, abs=2e-6), (name, feature)


@pytest.mark.parametrize("seed,idle,active,slice_seconds", [(1, 5.0, 5.0, 7.0), (2, 30.0, 5.0, 0.9), (3, 30.0, 5.0, None), (4, 12.0, 2.0, 1000.0)])
def test_features(spark, seed, idle, active, slice_seconds):
    rows = make_packets(seed)
    flows = M.flow_features(frame(spark, rows), idle_timeout=idle, active_gap=active, slice_seconds=slice_seconds)
    check(flows, plain_flows(rows, idle, active, 1.0))


def test_busy_tuple_is_cut_into_short_slices(spark):
    rows = [(i, START + i * 1000, "a", "b", 1, 2, "TCP", 100, "A", 20, 5, 0) for i in range(3000)]
    keyed = M.flow_key(frame(spark, rows)).withColumn("us", F.unix_micros("ts"))
    assert M.measured_slice(keyed, rows_per_slice=300) == pytest.approx(6.0)
    assert M.measured_slice(keyed) == 60.0


def test_gap_equal_to_the_timeout_opens_a_flow(spark):
    rows = [(0, START, "a", "b", 1, 2, "UDP", 50, None, 8, None, 0), (1, START + 5_000_000, "b", "a", 2, 1, "UDP", 60, None, 8, None, 0),
            (2, START + 9_999_999, "b", "a", 2, 1, "UDP", 70, None, 8, None, 0)]
    got = M.flow_records(frame(spark, rows), idle_timeout=5.0).orderBy("flow_start").collect()
    assert [(r["src_ip"], r["total_packets"], r["duration"], r["tcp_flags"]) for r in got] == [("a", 1, 0.0, "NONE"), ("b", 2, 5.0, "NONE")]


def test_packets_add_up(spark):
    rows = make_packets(9)
    sums = M.flow_records(frame(spark, rows), idle_timeout=8.0).agg(F.sum("total_packets").alias("n"), F.sum("total_bytes").alias("b")).first()
    assert (sums["n"], sums["b"]) == (len(rows), sum(r[7] for r in rows))


def test_short_timeout_is_refused(spark):
    with pytest.raises(ValueError):
        M.packet_shares(frame(spark, make_packets(1, 5)), idle_timeout=1.0)


def test_stream_with_disorder_and_late_packets(spark, tmp_path):
    rows = sorted(make_packets(5, n=300, span=200.0), key=lambda r: r[1])
    rng = random.Random(0)
    thirds = [rows[:100], rows[100:200], rows[200:]]
    swapped = [thirds[0][:90] + thirds[1][:5], thirds[0][90:] + thirds[1][5:], thirds[2]]
    too_late = [(900, START, "z", "y", 1, 2, "UDP", 9, None, 8, None, 0)]
    folder = str(tmp_path / "in")
    for part in (*swapped, too_late):
        part = list(part)
        rng.shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    last = SM.meter_stream(packet_stream(spark, folder, 1), out, state, str(tmp_path / "check"), delay_seconds=60.0, idle_timeout=10.0)
    early = spark.read.parquet(f"{out}/epoch=*").count()
    SM.flush(spark, out, state, last, idle_timeout=10.0)
    want = plain_flows(rows, 10.0, 5.0, 1.0)
    assert 0 < early < len(want)
    check(spark.read.parquet(f"{out}/epoch=*"), want)
    assert SM.late_packets(spark, state).agg(F.sum("n_late")).first()[0] == 1


def test_state_does_not_grow_with_an_open_flow(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows, sizes = [], []
    for part in range(5):
        step = [(part * 300 + i, START + (part * 300 + i) * 10_000, *(("a", "b", 1, 2) if i % 3 else ("b", "a", 2, 1)), "TCP", 60 + i, "PA", 20, 7, 0) for i in range(300)]
        rows += step
        frame(spark, step).coalesce(1).write.mode("append").parquet(folder)
        last = SM.meter_stream(packet_stream(spark, folder, 1), out, state, str(tmp_path / "check"), delay_seconds=0.0, idle_timeout=10.0)
        held = {p: spark.read.parquet(f"{state}/{p}/epoch={last}") for p in SM.PARTS}
        sizes.append({p: df.count() for p, df in held.items()})
        assert sizes[-1] == {"carry": 1, "flows": 1, "waiting": 1} and len(held["flows"].columns) < 120
    assert sorted(p.name for p in (tmp_path / "state" / "flows").iterdir()) == [f"epoch={last - 1}", f"epoch={last}"]
    batch = frame(spark, rows[-300:])
    before = sorted(map(str, spark.read.parquet(f"{state}/flows/epoch={last}").collect()))
    SM.meter_step(batch, last, out, state, 0.0, {"idle_timeout": 10.0})  # a repeated batch
    assert sorted(map(str, spark.read.parquet(f"{state}/flows/epoch={last}").collect())) == before
    SM.flush(spark, out, state, last, idle_timeout=10.0)
    check(spark.read.parquet(f"{out}/epoch=*"), plain_flows(rows, 10.0, 5.0, 1.0))


def test_parts_of_a_flow_add_up_to_the_flow(spark):
    rows = frame(spark, make_packets(21)).persist()
    whole, nothing = M.shares_after(rows, None, idle_timeout=8.0)[0], None
    parts, edges = [], [START + s * 1_000_000 for s in (0, 70, 71, 200, 500)]
    for lo, hi in zip(edges, edges[1:]):
        shares, nothing = M.shares_after(rows.filter(F.unix_micros("ts").between(lo, hi - 1)), nothing, idle_timeout=8.0)
        parts.append(M.flow_partials(shares))
    together = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = M.features_of_flows(M.finished_flows(M.merged_partials(together)))
    assert sorted(map(str, got.collect())) == sorted(map(str, M.features_of_shares(whole).collect()))
