"""Cleaning and projection of labelled flow tables and flow records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.functions import fixed
from flowlark.functions.expr import col, default_text, finite, inline_table, is_attack, parse_time
from flowlark.operators.scale import checked_small

PROVENANCE = ["label", "Label", "dataset", "source_file", "source_split", "row_id"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def clean_numeric(df: DataFrame) -> DataFrame:
    """Infinite values become null; rows with any null go."""
    reals = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    made = df.select(*[finite(col(c)).alias(c) if c in reals else col(c).alias(c) for c in df.columns])
    # One test for each column, numbers first: a column that cannot be null is not worked out for it.
    order = sorted(df.columns, key=lambda c: c not in reals)
    return made.filter(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in order])) if order else made


def clean_numeric_report(df: DataFrame) -> DataFrame:
    """Rows before and after cleaning and the number removed, in one pass."""
    reals = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    whole = reduce(
        lambda a, b: a & b, [(finite(col(c)) if c in reals else col(c)).isNotNull() for c in df.columns]
    )
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count(F.when(whole, 1)).alias("rows_after"),
        F.count(F.when(~whole, 1)).alias("rows_removed"),
    )


def clean_label(label: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.LABEL_FIXES.items() for x in pair]
    text = F.trim(label)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), text)


def clean_labels(df: DataFrame, column: str = "label") -> DataFrame:
    return df.withColumn(column, clean_label(col(column)))


def split_features_labels(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Features and labels apart; both keep row_id where there is one, for joining again."""
    ids = [c for c in ("row_id",) if c in df.columns]
    features = df.select(*ids, *[col(c) for c in df.columns if c not in PROVENANCE])
    return features, df.select(*ids, col(label))


def numeric_features(df: DataFrame) -> DataFrame:
    """Numeric columns only, without labels and provenance; row_id stays as the key."""
    keep = [c for c in numeric_columns(df) if c not in PROVENANCE]
    return df.select(*[c for c in ("row_id",) if c in df.columns], *[col(c) for c in keep])


def binary_label(label: Column) -> Column:
    return F.when(label == "BENIGN", 0).otherwise(1)


def label_index(df: DataFrame, column: str = "label") -> DataFrame:
    """Alphabetical ids from 0 per distinct label."""
    from pyspark.sql import Window

    labels = df.select(col(column).alias("label")).distinct()
    return labels.select("label", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1).alias("label_id"))


def label_from_index(df: DataFrame, ids: DataFrame, id_column: str, default: str = "UNKNOWN") -> DataFrame:
    """Ids back to labels; an unknown id gives the default."""
    names = ids.select(F.col("label_id").alias(id_column), F.col("label").alias("__name"))
    return df.join(names, id_column, "left").withColumn("label", F.coalesce("__name", F.lit(default))).drop("__name")


def normalize_flow(df: DataFrame, received_at: Column) -> DataFrame:
    """Flow records with defaults, numbers as numbers, text as text.

    A present but unreadable number marks the row: `rejected` lists those fields.
    """
    have = set(df.columns)
    changes: dict[str, Column] = {}
    bad = []
    for name in fixed.FLOW_REAL + fixed.FLOW_WHOLE:
        whole = name in fixed.FLOW_WHOLE
        if name not in have:
            changes[name] = F.lit(0).cast("bigint") if whole else F.lit(0.0)
            continue
        text = F.trim(col(name).cast("string"))
        number = text.try_cast("double")
        if whole:
            fits = F.coalesce(F.abs(number) < F.lit(9.0e18), F.lit(False))
            changes[name] = F.when(col(name).isNull(), F.lit(0)).when(fits, number.try_cast("bigint")).cast("bigint")
            broken = col(name).isNotNull() & ~fits
        else:
            changes[name] = F.when(col(name).isNull(), F.lit(0.0)).otherwise(number)
            broken = col(name).isNotNull() & number.isNull()
        bad.append(F.when(broken, F.lit(name)))
    for name, default in fixed.FLOW_TEXT_DEFAULTS.items():
        value = F.coalesce(col(name).cast("string"), F.lit(default)) if name in have else F.lit(default)
        changes[name] = F.upper(value) if name == "protocol" else value
    changes["timestamp"] = F.coalesce(col("timestamp").cast("string"), received_at) if "timestamp" in have else received_at
    rejected = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    rest = [col(c) for c in df.columns if c not in changes]
    return df.select(*rest, *[v.alias(k) for k, v in changes.items()], rejected.alias("rejected"))


def flatten_features(df: DataFrame, nested: str = "model_features") -> DataFrame:
    """Nested features move to the top level and win over same-named columns."""
    inner = [f.name for f in df.schema[nested].dataType.fields]
    lifted = [
        F.when(col(nested).isNotNull(), F.coalesce(F.col(f"{nested}.`{n}`"), col(n) if n in df.columns else F.lit(None))).otherwise(
            col(n) if n in df.columns else F.lit(None)
        ).alias(n)
        for n in inner
    ]
    outer = [c for c in df.columns if c not in inner and c not in (nested, "timestamp")]
    stamp = F.coalesce(
        col("timestamp") if "timestamp" in df.columns else F.lit(None), col("received_at") if "received_at" in df.columns else F.lit(None)
    )
    return df.select(*[col(c) for c in outer], *lifted, stamp.alias("timestamp"))


def align_features(df: DataFrame, expected: list[str], keep: list[str] | None = None) -> DataFrame:
    """The expected features in order as doubles: missing column or unreadable value is 0,
    a boolean 1 or 0."""
    meta = [c for c in df.columns if c in fixed.METADATA] if keep is None else keep
    out = []
    for name in expected:
        if name in df.columns:
            text = not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))
            number = col(name).cast("string").try_cast("double") if text else col(name).cast("double")
            out.append(F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0)).alias(name))
        else:
            out.append(F.lit(0.0).alias(name))
    return df.select(*[col(c) for c in meta], *out)


def parse_timestamps(df: DataFrame, column: str, fallback: Column) -> DataFrame:
    return df.withColumn(column, parse_time(col(column), fallback))


def blank_to_default(df: DataFrame, column: str, default: str) -> DataFrame:
    return df.withColumn(column, default_text(col(column), F.lit(default)))


def standard_scale(df: DataFrame, columns: list[str], fit_on: Column) -> DataFrame:
    """z-scores with mean and population deviation of the fitting rows; zero deviation scales by 1."""
    fit = df.filter(fit_on).agg(
        *[F.avg(col(c)).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(col(c)).alias(f"__s_{c}") for c in columns]
    )
    scaled = df.crossJoin(fit)  # one row
    return scaled.select(
        *[col(c) for c in df.columns if c not in columns],
        *[
            (
                (col(c) - F.col(f"`__m_{c}`"))
                / F.when(F.coalesce(F.col(f"`__s_{c}`"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"`__s_{c}`"))
            ).alias(c)
            for c in columns
        ],
    )


def rare_label_merge(df: DataFrame, fit_on: Column, limit: int = 100, other: str = "OtherAttack") -> DataFrame:
    """Labels with fewer fitting rows than the limit become one label in every row.

    Labels absent from the fitting rows are left as they are.
    """
    rare = df.filter(fit_on).groupBy("label").count().filter(F.col("count") < limit)
    rare = rare.select("label", F.lit(True).alias("__rare"))
    return (
        df.join(checked_small(rare), "label", "left")
        .withColumn("label", F.when(F.col("__rare"), F.lit(other)).otherwise(F.col("label")))
        .select(*df.columns)
    )


def date_range(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from the start of the first day to the end of the last day; undated rows go."""
    out = df.filter(col(ts).isNotNull())
    if start:
        out = out.filter(col(ts) >= F.to_timestamp(F.lit(start)))
    if end:
        out = out.filter(col(ts) < F.to_timestamp(F.lit(end)) + F.expr("interval 1 day"))
    return out


def severity_filter(df: DataFrame, chosen: list[str], columns: list[str]) -> DataFrame:
    return df.filter(F.col("severity").isin(*chosen)).select(*columns)


def attack_rows(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(is_attack(col(label)))


def split_of_file(df: DataFrame, files: list[tuple[str, str]]) -> DataFrame:
    """The split each row belongs to by its source file; rows of other files go."""
    dim = inline_table(df.sparkSession, files, ["source_file", "split"])
    return df.join(F.broadcast(dim), "source_file").select(*df.columns, "split")
