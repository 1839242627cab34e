"""Column expressions shared by the operators. All stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, also when the name holds dots or slashes."""
    return F.col(quote(name))


def inline_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table as a local relation; the planner knows its size and broadcasts it."""

    def text(value) -> str:
        if value is None:
            return "cast(null as string)"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(value, (list, tuple)):
            return "array(" + ", ".join(text(v) for v in value) + ")"
        return repr(value)

    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as t({', '.join(names)})")


def is_attack(label: Column) -> Column:
    """True unless the label is exactly BENIGN; a missing label counts as attack."""
    return ~label.eqNullSafe(F.lit("BENIGN"))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives 0 when the divisor is 0 or nothing."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def finite(value: Column) -> Column:
    """Null for NaN and both infinities. NaN compares above infinity, so one test does."""
    v = value.cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def default_text(value: Column, default: Column | None = None) -> Column:
    """Null and blank text become the default."""
    text = value.cast("string")
    return F.coalesce(F.when(F.trim(text) != "", text), default if default is not None else F.lit(None).cast("string"))


def parse_time(text: Column, fallback: Column) -> Column:
    """ISO-8601 text in any offset to an instant; blank or broken text gives the fallback."""
    return F.coalesce(F.try_to_timestamp(F.trim(text.cast("string"))), fallback)


def hash_order(row_id: Column, seed: int | str) -> Column:
    """A reproducible shuffle key: equal on every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string")))


def hash_unit(row_id: Column, seed: int | str) -> Column:
    """A reproducible number in [0, 1) from the first 48 bits of the shuffle key."""
    return F.conv(F.substring(hash_order(row_id, seed), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def round_exact(value: Column, places: int) -> Column:
    """Rounds the exact binary value, true ties to the even digit; plain round goes by the decimal text."""
    return F.replace(F.format_number(value.cast("double"), places), F.lit(","), F.lit("")).cast("double")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def stamp(ts: Column) -> Column:
    """Timestamp as text with microseconds, zone free."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def minute_bucket(ts: Column, minutes: int) -> Column:
    """Start of the bucket of so many minutes; buckets start anew each hour."""
    hour = F.date_trunc("hour", ts)
    steps = F.floor(F.minute(ts) / F.lit(minutes)) * F.lit(minutes * 60)
    return F.timestamp_seconds(F.unix_timestamp(hour) + steps)
