"""Zero-filled series, report roll-ups and newest-N views.

Everything counts back from an explicit `as_of`, so a query gives the same rows tomorrow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.functions.expr import inline_table
from flowlark.operators.alerts import two_places
from flowlark.operators.clean import date_range
from flowlark.operators.scale import newest_rows
from flowlark.session import cut_lineage

LABEL_FORMAT = {"second": "HH:mm:ss", "minute": "HH:mm", "hour": "HH:00", "day": "yyyy-MM-dd"}
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _at(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def unit_series(df: DataFrame, unit: str, n: int, as_of: str, ts: str = "received_at", packets: str = "total_packets") -> DataFrame:
    """Packets in each of the last n seconds, minutes, hours or days, zeros kept.

    The time limits reach the scan, and the sum combines on the map side.
    """
    last = F.date_trunc(unit, _at(as_of))
    first = last - F.expr(f"interval {n - 1} {unit}s")
    inside = df.filter((F.col(ts) >= first) & (F.col(ts) < last + F.expr(f"interval 1 {unit}")))
    sums = inside.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.sum(packets).cast("bigint").alias("y"))
    spine = df.sparkSession.range(n).select(
        F.col("id").alias("position"), F.timestamp_seconds(F.unix_timestamp(first) + F.col("id") * SECONDS[unit]).alias("bucket")
    )
    return spine.join(sums, "bucket", "left").select(
        "position", F.date_format("bucket", LABEL_FORMAT[unit]).alias("x"), F.coalesce("y", F.lit(0)).alias("y")
    ).orderBy("position")


def packets_per_second(df, as_of, **names):
    return unit_series(df, "second", 60, as_of, **names)


def packets_per_minute(df, as_of, **names):
    return unit_series(df, "minute", 60, as_of, **names)


def packets_per_hour(df, as_of, **names):
    return unit_series(df, "hour", 24, as_of, **names)


def packets_per_day(df, as_of, days: int = 7, **names):
    return unit_series(df, "day", days, as_of, **names)


def _poll_micros(poll_seconds) -> int:
    """Length of a polling interval. A bad or non-positive one means 3 s."""
    try:
        poll = float(poll_seconds)
    except (TypeError, ValueError):
        poll = 3.0
    return int(round((poll if poll > 0 else 3.0) * 1_000_000))


def poll_position(ts: str, as_of: str, step: int, divisions: int) -> Column:
    """The polling interval a time lies in, counted so that the last one ends at as_of; null outside."""
    now = F.date_trunc("second", _at(as_of))
    oldest = F.timestamp_micros(F.unix_micros(now) - (divisions - 1) * step)
    back = F.floor((F.unix_micros(now) - F.unix_micros(F.col(ts).cast("timestamp"))) / F.lit(step))
    return F.when((F.col(ts) >= oldest) & (F.col(ts) <= now), F.lit(divisions - 1) - back)


def _poll_series(placed: DataFrame, as_of: str, step: int, divisions: int, packets: str) -> DataFrame:
    """Rows with their polling interval in `poll` as the zero-filled series."""
    sums = placed.filter(F.col("poll").isNotNull()).groupBy(F.col("poll").alias("position")).agg(F.sum(packets).cast("bigint").alias("y"))
    spine = placed.sparkSession.range(divisions).select(F.col("id").alias("position"))
    now = F.unix_micros(F.date_trunc("second", _at(as_of)))
    label = F.date_format(F.timestamp_micros((now - (F.lit(divisions - 1) - F.col("position")) * step).cast("bigint")), "HH:mm:ss")
    return spine.join(sums, "position", "left").select("position", label.alias("x"), F.coalesce("y", F.lit(0)).alias("y")).orderBy("position")


def poll_activity(
    df: DataFrame, as_of: str, poll_seconds=3, divisions: int = 50, ts: str = "received_at", packets: str = "total_packets"
) -> DataFrame:
    """Packets per polling interval counted back from as_of. A bad or non-positive interval means 3 s."""
    step = _poll_micros(poll_seconds)
    now = F.date_trunc("second", _at(as_of))
    inside = df.filter((F.col(ts) >= F.timestamp_micros(F.unix_micros(now) - (divisions - 1) * step)) & (F.col(ts) <= now))
    return _poll_series(inside.withColumn("poll", poll_position(ts, as_of, step, divisions)), as_of, step, divisions, packets)


def tidy_label(label: Column) -> Column:
    return F.when(F.upper(label) == "BENIGN", "benign").otherwise(F.coalesce(label, F.lit("unknown")))


def attack_counts(df: DataFrame, label: str = "attack_label", with_benign: bool = True) -> DataFrame:
    """Flows per label; benign is always there unless left out on purpose."""
    return _with_benign(df.groupBy(tidy_label(F.col(label)).alias("label")).agg(F.count(F.lit(1)).alias("n_flows")), with_benign)


def _with_benign(counts: DataFrame, with_benign: bool = True) -> DataFrame:
    if not with_benign:
        return counts.filter(F.col("label") != "benign")
    zero = inline_table(counts.sparkSession, [("benign", 0)], ["label", "n_flows"])
    return counts.unionByName(zero.withColumn("n_flows", F.col("n_flows").cast("bigint"))).groupBy("label").agg(F.sum("n_flows").alias("n_flows"))


def _hourly(df: DataFrame, ts: str, label: str, packets: str) -> DataFrame:
    """Flows and packets per day, hour and label: small, and the base of all day roll-ups."""
    return df.groupBy(
        F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "HH:00").alias("hour"), tidy_label(F.col(label)).alias("label")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(packets).cast("bigint").alias("packets"))


def daily_report(df: DataFrame, ts: str = "received_at", label: str = "attack_label", packets: str = "total_packets") -> DataFrame:
    """Rows (day, kind, key, value): flows of the day, flows per label, packets of each of 24 hours."""
    return _daily(_hourly(df.filter(F.col(ts).isNotNull()), ts, label, packets))


def _daily(base: DataFrame) -> DataFrame:
    flows = base.groupBy("day").agg(F.sum("n").alias("value")).select("day", F.lit("flows").alias("kind"), F.lit("").alias("key"), "value")
    days = base.groupBy("day").agg(F.max("day").alias("d")).select("day")
    labels = base.groupBy("day", F.col("label").alias("key")).agg(F.sum("n").alias("value"))
    zero = days.select("day", F.lit("benign").alias("key"), F.lit(0).cast("bigint").alias("value"))
    labels = labels.unionByName(zero).groupBy("day", "key").agg(F.sum("value").alias("value"))
    spine = days.select("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.format_string("%02d:00", h))).alias("key"))
    hours = base.groupBy("day", F.col("hour").alias("key")).agg(F.sum("packets").alias("value"))
    hours = spine.join(hours, ["day", "key"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    return flows.unionByName(labels.select("day", F.lit("label").alias("kind"), "key", "value")).unionByName(
        hours.select("day", F.lit("hour").alias("kind"), "key", "value")
    )


def second_sums(
    df: DataFrame, as_of: str, poll_seconds=3, by: tuple[str, ...] = (), divisions: int = 50,
    ts: str = "received_at", label: str = "attack_label", packets: str = "total_packets",
) -> DataFrame:
    """Flows `n` and `packets` per second, polling interval and label, worked out once: the base of every chart and report.

    One scan with a map-side-combined sum; the rows that are left grow with the seconds covered, not with the flows.
    """
    poll = poll_position(ts, as_of, _poll_micros(poll_seconds), divisions)
    keys = [F.date_trunc("second", F.col(ts)).alias("second"), poll.alias("poll"), tidy_label(F.col(label)).alias("label")]
    return cut_lineage(df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(packets).alias("packets")))


def chart_series(base: DataFrame, as_of: str, poll_seconds=3, divisions: int = 50) -> DataFrame:
    """All charts as rows (section, position, x, y), from the sums of `second_sums` with the same settings."""
    names = {"ts": "second", "packets": "packets"}
    counts = _with_benign(base.groupBy("label").agg(F.sum("n").alias("n_flows")))
    parts = [
        ("packet_activity", _poll_series(base, as_of, _poll_micros(poll_seconds), divisions, "packets")),
        ("per_second", packets_per_second(base, as_of, **names)),
        ("per_minute", packets_per_minute(base, as_of, **names)),
        ("per_hour", packets_per_hour(base, as_of, **names)),
        ("per_day", packets_per_day(base, as_of, **names)),
        ("attack_counts", counts.select(F.lit(0).cast("bigint").alias("position"), F.col("label").alias("x"), F.col("n_flows").alias("y"))),
    ]
    return reduce(DataFrame.unionByName, [p.select(F.lit(name).alias("section"), "position", "x", "y") for name, p in parts])


def report_bundle(df: DataFrame, as_of: str, start: str | None, end: str | None, poll_seconds=3, ts: str = "received_at") -> DataFrame:
    """Range filter, then all charts and the day roll-ups as rows (section, position, x, y), from one scan of the table."""
    base = second_sums(date_range(df, ts, start, end), as_of, poll_seconds, ts=ts)
    timed = base.filter(F.col("second").isNotNull())
    hourly = timed.groupBy(F.date_format("second", "yyyy-MM-dd").alias("day"), F.date_format("second", "HH:00").alias("hour"), "label")
    days = _daily(hourly.agg(F.sum("n").alias("n"), F.sum("packets").cast("bigint").alias("packets"))).select(
        F.concat_ws(" ", F.lit("day"), "day", "kind").alias("section"), F.lit(0).cast("bigint").alias("position"), F.col("key").alias("x"),
        F.col("value").alias("y"),
    )
    return chart_series(base, as_of, poll_seconds).unionByName(days)


def alert_severity_counts(records: DataFrame) -> DataFrame:
    """Alert records per severity; an unknown severity counts as low."""
    level = F.lower(F.coalesce("severity", F.lit("low")))
    known = F.when(level.isin("critical", "high", "medium"), level).otherwise("low")
    return records.agg(*[F.count(F.when(known == s, 1)).alias(s) for s in ("critical", "high", "medium", "low")])


def alert_severity_from_text(lines: DataFrame, line: str = "line") -> DataFrame:
    """Severity guessed from alert text. A line naming DDOS counts as critical and as high."""
    text = F.upper(line)

    def has(*words):
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        return F.count(F.when(hit, 1))

    critical, high, medium = has("CRITICAL", "DDOS"), has("HIGH", "DOS"), has("POTENTIAL")
    counted = lines.agg(critical.alias("critical"), high.alias("high"), medium.alias("medium"), F.count(F.lit(1)).alias("n"))
    low = F.greatest(F.col("n") - F.col("critical") - F.col("high") - F.col("medium"), F.lit(0))
    return counted.select("critical", "high", "medium", low.alias("low"))


def newest(df: DataFrame, n: int, ts: str = "received_at", tie: str = "row_index", by: str = "mode") -> DataFrame:
    """The newest n rows of each mode. No task ranks a whole mode."""
    return newest_rows(df, by, ts, tie, n)


def recent_n(df: DataFrame, kind: str, **names) -> DataFrame:
    return newest(df, fixed.RECENT[kind], **names)


def clock(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _joined(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def feed_line(ts: Column) -> Column:
    c = F.col
    return _joined(
        clock(ts), " | ", c("src_ip"), ":", c("src_port").cast("string"), " -> ", c("dst_ip"), ":", c("dst_port").cast("string"), " | ",
        c("protocol"), " | packets=", c("total_packets").cast("string"), " | bytes=", c("total_bytes").cast("string"), " | duration=",
        two_places(c("duration")), "s | ", c("binary_label"), " | ", c("attack_label"),
    )


def suspicious_line(ts: Column) -> Column:
    c = F.col
    return _joined(
        clock(ts), " | ", c("src_port").cast("string"), " | ", c("dst_port").cast("string"), " | ", two_places(c("duration")), "s | ",
        c("total_bytes").cast("string"), " bytes | ", c("attack_label"), " | severity=", F.coalesce(c("severity"), F.lit("unknown")),
    )


def alert_line() -> Column:
    c = F.col
    return _joined(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), " - ", F.upper(F.coalesce(c("severity"), F.lit("unknown"))), " ",
        F.coalesce(c("attack_type"), F.lit("UNKNOWN")), " from ", F.coalesce(c("source_ip"), F.lit("unknown")), " to ",
        F.coalesce(c("destination_ip"), F.lit("unknown")),
    )


def insight_context(alert_lines: DataFrame, suspicious_lines: DataFrame, n: int = 5) -> DataFrame:
    """Per mode the newest alert lines and suspicious lines as text blocks, newest first.

    Inputs: mode, received_at, row_index, line. A mode without alerts gives no row.
    """

    def block(df: DataFrame, name: str) -> DataFrame:
        latest = newest(df, n).select("mode", F.struct((-F.unix_micros("received_at")).alias("a"), (-F.col("row_index")).alias("b"), "line").alias("s"))
        lines = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"])  # at most n lines
        return latest.groupBy("mode").agg(F.array_join(lines, "\n").alias(name))

    return block(alert_lines, "alerts").join(block(suspicious_lines, "suspicious"), "mode", "left").withColumn(
        "suspicious", F.coalesce("suspicious", F.lit(""))
    )


def without_repeats(history: DataFrame, text: str = "insight", ts: str = "received_at", tie: str = "row_index", by: str = "mode") -> DataFrame:
    """Drops an entry equal to the one before it in its mode; blank entries never count.

    The text before the first entry of an hour is found from one row per hour, so only
    single hours are sorted.
    """
    kept = history.filter(F.coalesce(F.col(text), F.lit("")) != "").withColumn("__h", F.date_trunc("hour", ts))
    order = F.struct(ts, tie)
    ends = kept.groupBy(by, "__h").agg(F.max_by(text, order).alias("__end"))
    ends = ends.select(by, "__h", F.lag("__end").over(Window.partitionBy(by).orderBy("__h")).alias("__carry"))
    inside = Window.partitionBy(by, "__h").orderBy(ts, tie)
    rows = kept.join(ends, [by, "__h"]).withColumn("__before", F.coalesce(F.lag(text).over(inside), "__carry"))
    return rows.filter(~F.col(text).eqNullSafe(F.col("__before"))).select(*history.columns)


def dashboard_snapshot(df: DataFrame, as_of: str, poll_seconds=3) -> DataFrame:
    """Totals per mode and every chart of each mode as rows (mode, section, position, x, y), over all flows in one scan."""
    base = second_sums(df, as_of, poll_seconds, by=("mode",))
    none = F.lit(0).cast("bigint")
    totals = base.groupBy("mode").agg(
        F.sum("n").alias("total_flows"),
        F.sum(F.when(F.col("label") == "benign", F.col("n")).otherwise(none)).alias("benign_count"),
        F.sum(F.when(~F.col("label").isin("benign", "unclassified"), F.col("n")).otherwise(none)).alias("not_benign_count"),
    )
    out = totals.select(
        "mode", F.lit("summary").alias("section"),
        F.expr("stack(3, 0L, 'total_flows', total_flows, 1L, 'benign_count', benign_count, 2L, 'not_benign_count', not_benign_count) as (position, x, y)"),
    )
    for mode in ("simulator", "network"):
        part = chart_series(base.filter(F.col("mode") == mode), as_of, poll_seconds)
        out = out.unionByName(part.select(F.lit(mode).alias("mode"), "section", "position", "x", "y"))
    return out
