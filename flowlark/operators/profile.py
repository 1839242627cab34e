"""Profiles of flow tables. Every profile over many columns is one pass: a single
aggregate over all columns, turned to rows afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.functions.expr import col, finite, is_attack
from flowlark.operators.clean import PROVENANCE, numeric_columns
from flowlark.operators.scale import exact_quantile, settle


def features_of(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if c not in PROVENANCE]


def _by_column(df: DataFrame, columns: list[str], measures: dict, group: list[str] | None = None) -> DataFrame:
    """One aggregate holding every measure of every column, then one row per column."""
    group = group or []
    packed = [F.struct(F.lit(c).alias("feature"), *[m(c).alias(n) for n, m in measures.items()]) for c in columns]
    wide = df.groupBy(*group).agg(F.array(*packed).alias("__all"))
    return wide.select(*group, F.explode("__all").alias("__one")).select(*group, "__one.*")


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).count()
    whole = counts.agg(F.sum("count").alias("n"))
    return counts.crossJoin(whole).select(  # one row
        label, F.col("count").alias("n_rows"), F.round(F.col("count") / F.col("n") * 100, 2).alias("pct")
    )


def missing_and_inf(df: DataFrame) -> DataFrame:
    """Per column: nulls and infinite values, with table rows and cells beside them."""
    reals = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def nulls(c: str) -> Column:
        gone = col(c).isNull() | (F.isnan(col(c)) if c in reals else F.lit(False))
        return F.count(F.when(gone, 1))

    def infinite(c: str) -> Column:
        return F.count(F.when(F.abs(col(c)) == float("inf"), 1)) if c in reals else F.lit(0).cast("bigint")

    out = _by_column(df, df.columns, {"n_null": nulls, "n_inf": infinite, "n_rows": lambda c: F.count(F.lit(1))})
    return out.withColumn("n_cells", F.col("n_rows") * len(df.columns))


def split_summary(df: DataFrame) -> DataFrame:
    """Rows and attack rows per split with their shares in percent."""
    per = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(is_attack(F.col("label")), 1)).alias("attack_rows")
    )
    whole = per.agg(F.sum("n_rows").alias("n"))
    return per.crossJoin(whole).select(  # one row
        "split", "n_rows", F.round(F.col("n_rows") / F.col("n") * 100, 1).alias("pct"), "attack_rows",
        F.round(F.col("attack_rows") / F.col("n_rows") * 100, 1).alias("attack_pct"),
    )


def label_by_split(df: DataFrame, splits: list[str] = ("train", "valid", "test")) -> DataFrame:
    wide = df.groupBy("label").pivot("split", list(splits)).count().na.fill(0)
    total = sum((F.col(s) for s in splits[1:]), F.col(splits[0]))
    return wide.withColumn("total", total).orderBy(F.col("total").desc(), "label")


def label_by_file(df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows per source file and label with a TOTAL column; the labels are given, so no extra pass."""
    wide = df.groupBy("source_file").pivot("label", labels).count().na.fill(0)
    totals = sum((col(x) for x in labels[1:]), col(labels[0]))
    return wide.withColumn("TOTAL", totals)


def feature_moments(df: DataFrame) -> DataFrame:
    # measures leave out null and infinite values
    return _by_column(
        df,
        features_of(df),
        {
            "variance": lambda c: F.var_samp(finite(col(c))),
            "mean": lambda c: F.avg(finite(col(c))),
            "std": lambda c: F.stddev_samp(finite(col(c))),
            "least": lambda c: F.min(finite(col(c))),
            "greatest": lambda c: F.max(finite(col(c))),
        },
    )


def top_variance_features(df: DataFrame, n: int = 10) -> DataFrame:
    best = feature_moments(df).orderBy(F.col("variance").desc_nulls_last(), "feature").limit(n)
    return best.select("feature", *[F.round(c, 3).alias(c) for c in ("mean", "std", "least", "greatest")])


def benign_attack_contrast(df: DataFrame, n: int = 10) -> DataFrame:
    """Features whose means differ most between BENIGN and the rest."""
    bad = is_attack(F.col("label"))
    means = _by_column(
        df,
        features_of(df),
        {
            "benign_mean": lambda c: F.avg(F.when(~bad, finite(col(c)))),
            "attack_mean": lambda c: F.avg(F.when(bad, finite(col(c)))),
        },
    )
    return (
        means.withColumn("abs_diff", F.abs(F.col("attack_mean") - F.col("benign_mean")))
        .orderBy(F.col("abs_diff").desc_nulls_last(), "feature")
        .limit(n)
    )


def clipped_histogram(df: DataFrame, feature: str, bins: int = 40) -> DataFrame:
    """Density per bin for BENIGN and ATTACK, values clipped at the larger 99th percentile.

    Bins span each class's own range after clipping, as a plain density histogram does.
    """
    rows = df.select(
        F.when(is_attack(F.col("label")), "ATTACK").otherwise("BENIGN").alias("side"), finite(col(feature)).alias("v")
    ).filter(F.col("v").isNotNull())
    tops = exact_quantile(rows, ["side"], "v", 0.99).agg(F.max("quantile").alias("upper"))
    clipped = rows.crossJoin(F.broadcast(tops)).select("side", F.least("v", "upper").alias("v"))  # one row
    span = settle(clipped.groupBy("side").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = clipped.join(span, "side").groupBy("side", at.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    return grid.join(counts, ["side", "bin"], "left").select(
        "side", "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), F.coalesce("c", F.lit(0)).alias("n_rows"),
        F.coalesce(F.try_divide(F.coalesce("c", F.lit(0)).cast("double"), F.col("n") * width), F.lit(0.0)).alias("density"),
    )


def rare_labels(df: DataFrame, limit: int = 100) -> DataFrame:
    counts = df.filter(is_attack(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter(F.col("n_rows") < limit)


def schema_parity(splits: dict[str, DataFrame]) -> DataFrame:
    """Whether each split has the first one's feature columns, and its null and infinite cells."""
    first = features_of(next(iter(splits.values())))
    parts = []
    for name, df in splits.items():
        own = features_of(df)
        reals = [c for c in own if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
        nulls = sum((F.count(F.when(col(c).isNull(), 1)) for c in own), F.lit(0))
        infs = sum((F.count(F.when(F.abs(col(c)) == float("inf"), 1)) for c in reals), F.lit(0))
        parts.append(
            df.agg(
                F.lit(name).alias("split"), F.lit(int(own == first)).alias("same_columns"),
                nulls.cast("bigint").alias("n_null"), infs.cast("bigint").alias("n_inf"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def binary_balance(df: DataFrame) -> DataFrame:
    bad = F.count(F.when(is_attack(F.col("label")), 1))
    n = F.count(F.lit(1))
    return df.groupBy("split").agg(
        (n - bad).alias("benign"), bad.alias("attack"),
        F.round((n - bad) / n * 100, 2).alias("benign_pct"), F.round(bad / n * 100, 2).alias("attack_pct"),
    )


def mode_counters(df: DataFrame) -> DataFrame:
    """Running totals per mode; rows without a prediction count in the total only.

    Works on a stream as well, in complete or update mode.
    """
    return df.groupBy("mode").agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.count(F.when(F.col("binary_label") == "BENIGN", 1)).alias("benign_count"),
        F.count(F.when(F.col("binary_label") == "NOT BENIGN", 1)).alias("not_benign_count"),
    )


def request_stats(batches: DataFrame, incidents: DataFrame) -> DataFrame:
    """Requests, flows and alerts so far beside open incidents in total and per severity."""
    sums = batches.agg(
        F.count(F.lit(1)).alias("requests"), F.sum("flows").alias("flows_received"), F.sum("alerts").alias("alerts_generated")
    )
    opened = incidents.agg(
        F.count(F.lit(1)).alias("incidents_open"),
        *[F.count(F.when(F.col("severity") == s, 1)).alias(f"open_{s}") for s in ("critical", "high", "medium", "low")],
    )
    return sums.crossJoin(opened)  # one row each
