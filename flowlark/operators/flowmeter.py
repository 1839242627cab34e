"""Packets to bidirectional flows with 78 features.

A 5-tuple may carry a third of all packets, so no window spans a whole 5-tuple. Packets
are partitioned by (5-tuple, time slice). Inside a slice everything is told from the
packet before; one summary row per slice, added up along the 5-tuple, carries what began
in earlier slices: the time of the last packet, the open flow, the open active period and
the open bulk run of each direction. After that each packet knows its share of every
feature, and one grouped aggregate, combined on the map side, makes the flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.functions.expr import ratio, round_exact

KEY = ["k_ip1", "k_port1", "k_ip2", "k_port2", "protocol"]
FLOW = [*KEY, "flow_start", "flow_dir"]
MIN_BULK = 4
SIDES = (("a", True), ("b", False))


def flow_key(packets: DataFrame) -> DataFrame:
    """Adds the direction-free 5-tuple; `dir` is true where the source is its first endpoint."""
    low = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port")))
    return packets.select(
        "*",
        F.when(low, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("k_ip1"),
        F.when(low, F.col("src_port")).otherwise(F.col("dst_port")).alias("k_port1"),
        F.when(low, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("k_ip2"),
        F.when(low, F.col("dst_port")).otherwise(F.col("src_port")).alias("k_port2"),
        low.alias("dir"),
    )


def _us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def measured_slice(keyed: DataFrame, rows_per_slice: int = 2_000_000, longest: float = 60.0, shortest: float = 0.001) -> float:
    """Slice length at which the busiest 5-tuple's busiest minute splits into slices of about
    `rows_per_slice` packets."""
    minute = F.floor(F.col("us") / F.lit(60_000_000))
    busiest = keyed.groupBy(*KEY, minute.alias("m")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    return longest if busiest <= rows_per_slice else max(shortest, min(longest, 60.0 * rows_per_slice / busiest))


def packet_shares(packets: DataFrame, **limits) -> DataFrame:
    """Every packet with its flow and its share of the order-dependent features; see `shares_after`."""
    return shares_after(packets, None, **limits)[0]


#: What an earlier step hands on for each 5-tuple: the same measures that a time slice has.
CARRY = [*KEY, "first", "last", "first_dir", "opened", "woke", *(f"{m}_{s}" for s in "ab" for m in ("first", "last", "n", "bytes", "run"))]
BEFORE_ALL = -(2**62)


def shares_after(
    packets: DataFrame, carry: DataFrame | None, idle_timeout: float = 5.0, active_gap: float = 5.0, quiet_gap: float = 1.0, slice_seconds: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Every packet with its flow and its share of the order-dependent features, and the carry after them.

    carry: one row for each 5-tuple (columns CARRY) that stands for all its earlier packets, as this function gave
    it for them; it counts as one more slice before all others. None: there were no earlier packets.

    A gap of at least `idle_timeout` opens a new flow; a gap above `active_gap` ends an
    active period; one above `quiet_gap` ends a subflow or, within a direction, a bulk run.
    Ties in time are ordered by packet_id. Without a given slice length it is measured.
    """
    if idle_timeout <= quiet_gap:
        raise ValueError("the idle timeout must be longer than the bulk and subflow gap")
    idle, active, quiet = _us(idle_timeout), _us(active_gap), _us(quiet_gap)
    c = F.col
    rows = flow_key(packets.filter(c("protocol").isin("TCP", "UDP") & c("ts").isNotNull()))
    rows = rows.withColumn("us", F.unix_micros(c("ts").cast("timestamp")))
    if slice_seconds is None:
        slice_seconds = measured_slice(rows)
    rows = rows.withColumn("slice", F.floor(c("us") / F.lit(_us(slice_seconds))))

    part = [*KEY, "slice"]
    order = Window.partitionBy(*part).orderBy("us", "packet_id")
    side = Window.partitionBy(*part, "dir").orderBy("us", "packet_id")
    start, here = Window.unboundedPreceding, Window.currentRow

    local = rows.withColumn("prev", F.lag("us").over(order))
    local = local.withColumns(
        {
            "opens": c("us") - c("prev") >= idle,
            "wakes": c("us") - c("prev") > active,
        }
    ).withColumns(
        {
            "l_flow": F.max(F.when(c("opens"), F.struct("us", "dir"))).over(order.rowsBetween(start, here)),
            "l_wake": F.max(F.when(c("wakes"), c("us"))).over(order.rowsBetween(start, -1)),
        }
    )
    local = local.withColumns(
        {
            "d_prev": F.lag("us").over(side),
            "d_n": F.count(F.lit(1)).over(side.rowsBetween(start, here)),
            "d_bytes": F.sum("pkt_len").over(side.rowsBetween(start, here)),
        }
    )
    local = local.withColumn("breaks", c("us") - c("d_prev") > quiet)
    run_start = F.struct(c("us").alias("at"), c("d_n").alias("n"), (c("d_bytes") - c("pkt_len")).alias("bytes"))
    local = local.withColumn("l_run", F.max(F.when(c("breaks"), run_start)).over(side.rowsBetween(start, here)))

    # One row per slice, then sums and maxima over the earlier slices of the 5-tuple.
    measures = [
        F.min("us").alias("first"),
        F.max("us").alias("last"),
        F.min_by("dir", F.struct("us", "packet_id")).alias("first_dir"),
        F.max(F.when(c("opens"), F.struct("us", "dir"))).alias("opened"),
        F.max(F.when(c("wakes"), c("us"))).alias("woke"),
    ]
    for s, is_a in SIDES:
        mine = c("dir") == is_a
        measures += [
            F.min(F.when(mine, c("us"))).alias(f"first_{s}"),
            F.max(F.when(mine, c("us"))).alias(f"last_{s}"),
            F.count(F.when(mine, 1)).alias(f"n_{s}"),
            F.sum(F.when(mine, c("pkt_len")).otherwise(0)).alias(f"bytes_{s}"),
            F.max(F.when(mine & c("breaks"), run_start)).alias(f"run_{s}"),
        ]
    slices = local.groupBy(*part).agg(*measures)
    if carry is not None:
        slices = slices.unionByName(carry.withColumn("slice", F.lit(BEFORE_ALL).cast("bigint")))
    past = Window.partitionBy(*KEY).orderBy("slice").rowsBetween(start, -1)
    slices = slices.withColumns(
        {
            "c_prev": F.max("last").over(past),
            **{f"c_last_{s}": F.max(f"last_{s}").over(past) for s, _ in SIDES},
            **{f"c_n_{s}": F.coalesce(F.sum(f"n_{s}").over(past), F.lit(0)) for s, _ in SIDES},
            **{f"c_bytes_{s}": F.coalesce(F.sum(f"bytes_{s}").over(past), F.lit(0)) for s, _ in SIDES},
        }
    )
    head = F.struct(c("first").alias("us"), c("first_dir").alias("dir"))
    slices = slices.withColumns(
        {
            "h_opens": c("c_prev").isNull() | (c("first") - c("c_prev") >= idle),
            "h_wakes": F.coalesce(c("first") - c("c_prev") > active, F.lit(False)),
        }
    )
    first_run, last_run = {}, {}
    for s, _ in SIDES:
        fresh = c(f"c_last_{s}").isNull() | (c(f"first_{s}") - c(f"c_last_{s}") > quiet)
        begins = F.struct(c(f"first_{s}").alias("at"), (c(f"c_n_{s}") + 1).alias("n"), c(f"c_bytes_{s}").alias("bytes"))
        first_run[s] = F.when(c(f"first_{s}").isNotNull() & fresh, begins)
        moved = F.struct(
            c(f"run_{s}.at").alias("at"), (c(f"run_{s}.n") + c(f"c_n_{s}")).alias("n"), (c(f"run_{s}.bytes") + c(f"c_bytes_{s}")).alias("bytes")
        )
        last_run[s] = F.coalesce(F.when(c(f"run_{s}").isNotNull(), moved), first_run[s])
    opened_here = F.coalesce("opened", F.when(c("h_opens"), head))
    woke_here = F.coalesce("woke", F.when(c("h_wakes"), c("first")))
    sums = [
        F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("first_dir", "slice").alias("first_dir"),
        F.max(opened_here).alias("opened"), F.max(woke_here).alias("woke"),
    ]
    for s, _ in SIDES:
        sums += [
            F.min(f"first_{s}").alias(f"first_{s}"), F.max(f"last_{s}").alias(f"last_{s}"), F.sum(f"n_{s}").alias(f"n_{s}"),
            F.sum(f"bytes_{s}").alias(f"bytes_{s}"), F.max(last_run[s]).alias(f"run_{s}"),
        ]
    after = slices.groupBy(*KEY).agg(*sums)
    carried = slices.select(
        *part, "first", "c_prev", "h_opens", "h_wakes",
        F.coalesce(F.when(c("h_opens"), head), F.max(opened_here).over(past)).alias("h_flow"),
        F.max(woke_here).over(past).alias("c_woke"),
        *[f"c_{m}_{s}" for m in ("last", "n", "bytes") for s, _ in SIDES],
        *[F.coalesce(first_run[s], F.max(last_run[s]).over(past)).alias(f"h_run_{s}") for s, _ in SIDES],
    )

    def by_side(name: str) -> Column:
        return F.when(c("dir"), c(f"{name}_a")).otherwise(c(f"{name}_b"))

    whole = local.join(carried, part)
    whole = whole.withColumns(
        {
            "flow": F.coalesce("l_flow", "h_flow"),
            "iat": F.when(F.when(c("prev").isNull(), c("h_opens")).otherwise(c("opens")), F.lit(None)).otherwise(c("us") - F.coalesce("prev", "c_prev")),
            "before": F.coalesce("prev", "c_prev"),
            "side_before": F.coalesce("d_prev", by_side("c_last")),
            "woke_before": F.coalesce("l_wake", F.when(c("prev").isNotNull() & c("h_wakes"), c("first")), "c_woke"),
            "run": F.coalesce(
                F.when(
                    c("l_run").isNotNull(),
                    F.struct(c("l_run.at").alias("at"), (c("l_run.n") + by_side("c_n")).alias("n"), (c("l_run.bytes") + by_side("c_bytes")).alias("bytes")),
                ),
                by_side("h_run"),
            ),
        }
    )
    flow_start = c("flow.us")
    place = c("d_n") + by_side("c_n") - c("run.n") + 1
    counts = (place >= MIN_BULK) & (c("us") > c("run.at"))
    counted = (place - 1 >= MIN_BULK) & (c("side_before") > c("run.at"))
    enters = counts & ~counted
    wakes = c("iat") > active
    shares = whole.select(
        *KEY, "packet_id", "ts", "us", "pkt_len", "tcp_flags", "header_len", "window_size", "payload_len",
        flow_start.alias("flow_start"),
        c("flow.dir").alias("flow_dir"),
        (c("dir") == c("flow.dir")).alias("forward"),
        (c("d_n") + by_side("c_n")).alias("side_seq"),
        "iat",
        F.when(c("side_before") >= flow_start, c("us") - c("side_before")).alias("side_iat"),
        wakes.alias("wakes"),
        F.when(wakes, c("before") - F.greatest(flow_start, F.coalesce("woke_before", flow_start))).alias("active_us"),
        F.when(enters, 1).otherwise(0).alias("bulk_n"),
        F.when(enters, place).when(counts, 1).otherwise(0).alias("bulk_packets"),
        F.when(enters, c("d_bytes") + by_side("c_bytes") - c("run.bytes")).when(counts, c("pkt_len")).otherwise(0).alias("bulk_bytes"),
        F.when(enters, c("us") - c("run.at")).when(counts, c("us") - c("side_before")).otherwise(0).alias("bulk_us"),
        (c("iat") > quiet).alias("splits"),
    )
    return shares, after


def _zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


FLAGS = {"FIN": "F", "SYN": "S", "RST": "R", "PSH": "P", "ACK": "A", "URG": "U", "CWE": "C", "ECE": "E"}


def _partials() -> dict[str, tuple[str, Column]]:
    """Sums, least and greatest values of a flow that add up over its parts: name to (way of adding up, value of a packet).

    Moments are kept as count, sum and sum of squares of whole numbers, so they are exact in any order.
    """
    c = F.col
    fwd, bwd = c("forward"), ~c("forward")
    out: dict[str, tuple[str, Column]] = {"n": ("sum", F.lit(1)), "bytes": ("sum", c("pkt_len")), "last_us": ("max", c("us")), "woke_us": ("max", F.when(c("wakes"), c("us")))}

    def moments(name: str, value: Column) -> None:
        out[f"{name}_k"] = ("sum", F.when(value.isNotNull(), 1))
        out[f"{name}_s"] = ("sum", value)
        out[f"{name}_q"] = ("sum", value.cast("decimal(19,0)") * value.cast("decimal(19,0)"))
        out[f"{name}_min"], out[f"{name}_max"] = ("min", value), ("max", value)

    moments("len", c("pkt_len"))
    moments("iat", c("iat"))
    moments("idle", F.when(c("wakes"), c("iat")))
    moments("act", c("active_us"))
    for name, rows in (("fwd", fwd), ("bwd", bwd)):
        moments(f"len_{name}", F.when(rows, c("pkt_len")))
        moments(f"iat_{name}", F.when(rows, c("side_iat")))
        out |= {
            f"n_{name}": ("sum", F.when(rows, 1)), f"bytes_{name}": ("sum", F.when(rows, c("pkt_len"))),
            f"from_{name}": ("min", F.when(rows, c("us"))), f"to_{name}": ("max", F.when(rows, c("us"))),
            f"psh_{name}": ("sum", F.when(c("tcp_flags").contains("P") & rows, 1)), f"urg_{name}": ("sum", F.when(c("tcp_flags").contains("U") & rows, 1)),
            f"header_{name}": ("sum", F.when(rows, c("header_len"))),
            f"window_at_{name}": ("min", F.when(rows & c("window_size").isNotNull(), F.struct("side_seq", "window_size"))),
            **{f"{b}_{name}": ("sum", F.when(rows, c(b))) for b in ("bulk_n", "bulk_packets", "bulk_bytes", "bulk_us")},
        }
    out |= {f"flag_{name}": ("sum", F.when(c("tcp_flags").contains(letter), 1)) for name, letter in FLAGS.items()}
    out["data_fwd"] = ("sum", F.when(fwd & (c("payload_len") > 0), 1))
    out["min_header_fwd"] = ("min", F.when(fwd & (c("header_len") > 0), c("header_len")))
    out["splits"] = ("sum", F.when(c("splits"), 1))
    return out


_ADD = {"sum": F.sum, "min": F.min, "max": F.max}


def _added(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    ways = _partials()
    made = []
    for name, value in values.items():
        total = _ADD[ways[name][0]](value)
        if ways[name][0] == "sum":
            total = F.coalesce(total.cast("decimal(38,0)" if name.endswith("_q") else "bigint"), F.lit(0).cast("decimal(38,0)" if name.endswith("_q") else "bigint"))
        made.append(total.alias(name))
    return rows.groupBy(*FLOW).agg(*made)


def flow_partials(shares: DataFrame) -> DataFrame:
    """One row for each flow of what its packets add to it."""
    return _added(shares, {name: value for name, (_, value) in _partials().items()})


def merged_partials(parts: DataFrame) -> DataFrame:
    """Rows of the same flow as one."""
    return _added(parts, {name: F.col(name) for name in _partials()})


def finished_flows(partials: DataFrame) -> DataFrame:
    """The columns of `flow_aggregates` from merged partial rows."""
    c = F.col

    def spread(name: str) -> Column:
        k, s = c(f"{name}_k").cast("decimal(18,0)"), c(f"{name}_s").cast("decimal(19,0)")
        return (c(f"{name}_q") * k - s * s).cast("double")

    more = {}
    for name in ("len", "iat", "idle", "act", "len_fwd", "len_bwd", "iat_fwd", "iat_bwd"):
        k = c(f"{name}_k").cast("double")
        more[f"{name}_mean"] = F.when(k > 0, c(f"{name}_s") / k)
        more[f"{name}_var"] = F.when(k > 1, spread(name) / (k * (k - 1)))
        more[f"{name}_std"] = F.sqrt(more[f"{name}_var"])
    more["act_n"] = c("act_k")
    more["act_pop"] = F.when(c("act_k") > 0, spread("act") / (c("act_k").cast("double") * c("act_k")))
    for d in ("fwd", "bwd"):
        more[f"iat_{d}_total"] = c(f"to_{d}") - c(f"from_{d}")
        more[f"window_{d}"] = c(f"window_at_{d}.window_size")
    more["subflows"] = c("splits") + 1
    return partials.withColumns(more)


def flow_aggregates(shares: DataFrame) -> DataFrame:
    """One row per flow with all sums and moments."""
    c = F.col
    fwd, bwd = c("forward"), ~c("forward")

    def stats(name: str, value: Column) -> list[Column]:
        return [
            F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"), F.avg(value).alias(f"{name}_mean"),
            F.stddev_samp(value).alias(f"{name}_std"),
        ]

    def flagged(letter: str, rows: Column | None = None) -> Column:
        hit = c("tcp_flags").contains(letter)
        return F.count(F.when(hit if rows is None else hit & rows, 1))

    both = (("fwd", fwd), ("bwd", bwd))
    out = [F.count(F.lit(1)).alias("n"), F.sum("pkt_len").alias("bytes"), F.max("us").alias("last_us")]
    out += [*stats("len", c("pkt_len")), F.var_samp("pkt_len").alias("len_var"), *stats("iat", c("iat"))]
    for name, rows in both:
        out += [
            F.count(F.when(rows, 1)).alias(f"n_{name}"),
            F.sum(F.when(rows, c("pkt_len")).otherwise(0)).alias(f"bytes_{name}"),
            *stats(f"len_{name}", F.when(rows, c("pkt_len"))),
            *stats(f"iat_{name}", F.when(rows, c("side_iat"))),
            (F.max(F.when(rows, c("us"))) - F.min(F.when(rows, c("us")))).alias(f"iat_{name}_total"),
            flagged("P", rows).alias(f"psh_{name}"),
            flagged("U", rows).alias(f"urg_{name}"),
            F.sum(F.when(rows, c("header_len")).otherwise(0)).alias(f"header_{name}"),
            F.min_by("window_size", F.when(rows & c("window_size").isNotNull(), c("side_seq"))).alias(f"window_{name}"),
            *[F.sum(F.when(rows, c(b)).otherwise(0)).alias(f"{b}_{name}") for b in ("bulk_n", "bulk_packets", "bulk_bytes", "bulk_us")],
        ]
    out += [flagged(letter).alias(f"flag_{name}") for name, letter in FLAGS.items()]
    out += [
        F.count(F.when(fwd & (c("payload_len") > 0), 1)).alias("data_fwd"),
        F.min(F.when(fwd & (c("header_len") > 0), c("header_len"))).alias("min_header_fwd"),
        (F.count(F.when(c("splits"), 1)) + 1).alias("subflows"),
        *stats("idle", F.when(c("wakes"), c("iat"))),
        *stats("act", c("active_us")),
        F.count("active_us").alias("act_n"),
        F.var_pop("active_us").alias("act_pop"),
        F.max(F.when(c("wakes"), c("us"))).alias("woke_us"),
    ]
    return shares.groupBy(*FLOW).agg(*out)


def flag_texts(shares: DataFrame) -> DataFrame:
    """Per flow its distinct flag texts, sorted and joined; flows without any give no row."""
    texts = shares.filter(F.coalesce("tcp_flags", F.lit("")) != "").select(*FLOW, "tcp_flags").distinct()
    return texts.groupBy(*FLOW).agg(F.array_join(F.sort_array(F.collect_list("tcp_flags")), ",").alias("flag_text"))


def _with_last_active(flows: DataFrame) -> DataFrame:
    """Adds the period from the last wake-up to the last packet, if it is longer than 0."""
    c = F.col
    x = (c("last_us") - F.coalesce("woke_us", "flow_start")).cast("double")
    more = x > 0
    n1, mean1 = c("act_n"), F.coalesce("act_mean", F.lit(0.0))
    n = n1 + F.when(more, 1).otherwise(0)
    mean = F.when(more, (n1 * mean1 + x) / n).otherwise(mean1)
    squares = n1 * F.coalesce("act_pop", F.lit(0.0)) + F.when(more, (x - mean1) * (x - mean1) * n1 / n).otherwise(0.0)
    return flows.withColumns(
        {
            "active_mean": mean,
            "active_std": F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0),
            "active_max": F.greatest(_zero(c("act_max")), F.when(more, x).otherwise(0.0)),
            "active_min": F.when(more, F.least(F.coalesce(c("act_min").cast("double"), x), x)).otherwise(_zero(c("act_min"))),
        }
    )


def _endpoints() -> list[Column]:
    c = F.col
    return [
        F.when(c("flow_dir"), c("k_ip1")).otherwise(c("k_ip2")).alias("src_ip"),
        F.when(c("flow_dir"), c("k_ip2")).otherwise(c("k_ip1")).alias("dst_ip"),
        F.when(c("flow_dir"), c("k_port1")).otherwise(c("k_port2")).alias("src_port"),
        F.when(c("flow_dir"), c("k_port2")).otherwise(c("k_port1")).alias("dst_port"),
    ]


def feature_columns() -> list[Column]:
    """The 78 features in their fixed order, rounded to 6 places."""
    c = F.col
    us = F.greatest(c("last_us") - c("flow_start"), F.lit(1)).cast("double")
    seconds = us / 1_000_000

    def rate(top: str) -> Column:
        return c(top) / seconds

    def moments(name: str, order: str) -> list[Column]:
        return [_zero(c(f"{name}_{m}")) for m in order.split()]

    values: list[Column] = [F.when(c("flow_dir"), c("k_port2")).otherwise(c("k_port1")), us]
    values += [c("n_fwd"), c("n_bwd"), c("bytes_fwd"), c("bytes_bwd")]
    values += moments("len_fwd", "max min mean std") + moments("len_bwd", "max min mean std")
    values += [rate("bytes"), rate("n")] + moments("iat", "mean std max min")
    values += moments("iat_fwd", "total mean std max min") + moments("iat_bwd", "total mean std max min")
    values += [c("psh_fwd"), c("psh_bwd"), c("urg_fwd"), c("urg_bwd"), c("header_fwd"), c("header_bwd"), rate("n_fwd"), rate("n_bwd")]
    values += moments("len", "min max mean std") + [_zero(c("len_var"))]
    values += [c(f"flag_{name}") for name in FLAGS]
    values += [ratio(c("n_bwd"), c("n_fwd")), ratio(c("bytes"), c("n")), _zero(c("len_fwd_mean")), _zero(c("len_bwd_mean")), c("header_fwd")]
    for d in ("fwd", "bwd"):
        values += [
            ratio(c(f"bulk_bytes_{d}"), c(f"bulk_n_{d}")), ratio(c(f"bulk_packets_{d}"), c(f"bulk_n_{d}")),
            ratio(c(f"bulk_bytes_{d}"), c(f"bulk_us_{d}") / F.lit(1e6)),
        ]
    values += [ratio(c(x), c("subflows")) for x in ("n_fwd", "bytes_fwd", "n_bwd", "bytes_bwd")]
    values += [F.coalesce("window_fwd", F.lit(-1)), F.coalesce("window_bwd", F.lit(-1)), c("data_fwd"), F.coalesce("min_header_fwd", F.lit(0))]
    values += [c(f"active_{m}") for m in ("mean", "std", "max", "min")] + moments("idle", "mean std max min")
    assert len(values) == len(fixed.FLOW_FEATURES)
    return [round_exact(v, 6).alias(name) for v, name in zip(values, fixed.FLOW_FEATURES)]


def flow_features(packets: DataFrame, **limits) -> DataFrame:
    """Flow identity, start and end, and the 78 features."""
    return features_of_shares(packet_shares(packets, **limits))


def features_of_shares(shares: DataFrame) -> DataFrame:
    return features_of_flows(flow_aggregates(shares))


def features_of_flows(flows: DataFrame) -> DataFrame:
    return _with_last_active(flows).select(*_endpoints(), "protocol", F.timestamp_micros("flow_start").alias("flow_start"), "last_us", *feature_columns())


def flow_records(packets: DataFrame, **limits) -> DataFrame:
    """The flow summary record with the features as one nested struct."""
    c = F.col
    shares = packet_shares(packets, **limits)
    flows = _with_last_active(flow_aggregates(shares)).join(flag_texts(shares), FLOW, "left")
    seconds = F.greatest(c("last_us") - c("flow_start"), F.lit(1)) / F.lit(1e6)
    return flows.select(
        *_endpoints(), "protocol", round_exact(seconds, 4).alias("duration"), c("n").alias("total_packets"), c("bytes").alias("total_bytes"),
        c("n_fwd").alias("packets_src_to_dst"), c("n_bwd").alias("packets_dst_to_src"), c("bytes_fwd").alias("bytes_src_to_dst"),
        c("bytes_bwd").alias("bytes_dst_to_src"), round_exact(c("n") / seconds, 4).alias("packet_rate"),
        round_exact(c("bytes") / seconds, 4).alias("byte_rate"), round_exact(c("bytes") / c("n"), 4).alias("avg_packet_size"),
        F.coalesce("flag_text", F.lit("NONE")).alias("tcp_flags"), F.lit("unknown").alias("label"),
        F.timestamp_micros("flow_start").alias("flow_start"), F.timestamp_micros("last_us").alias("last_seen"),
        F.struct(*feature_columns()).alias("model_features"),
    )
