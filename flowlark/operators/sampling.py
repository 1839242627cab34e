"""Splits and samples with exact sizes, reproducible from row_id alone.

"Random" rows are those first in md5 order of seed and row_id, so any engine and any
partitioning picks the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.functions.expr import hash_order, inline_table, is_attack
from flowlark.operators.clean import binary_label, split_of_file
from flowlark.operators.scale import checked_small, first_rows, quota_cuts, within_cut

SEED = 42


def shuffle_key(seed: int = SEED) -> Column:
    return F.concat(hash_order(F.col("row_id"), seed), F.lit("|"), F.col("row_id"))


def shuffle_bucket(seed: int = SEED) -> Column:
    return F.substring(hash_order(F.col("row_id"), seed), 1, 4)


def temporal_split(df: DataFrame, files: list[tuple[str, str]]) -> DataFrame:
    return split_of_file(df, files)


def seed_attacks(df: DataFrame, fraction: float = 0.15, seed: int = SEED) -> DataFrame:
    """Moves max(1, whole part of fraction x n) rows of each attack class from valid to train.

    Rows meet one small row per class, so the table itself is not shuffled.
    """
    movable = (F.col("split") == "valid") & is_attack(F.col("label"))
    quota = {"q": lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(fraction)))}
    cuts = quota_cuts(df.filter(movable), ["label"], shuffle_key(seed), shuffle_bucket(seed), quota)
    moved = movable & F.coalesce(within_cut("q", shuffle_key(seed)), F.lit(False))
    joined = df.join(checked_small(cuts), "label", "left")
    return joined.withColumn("split", F.when(moved, F.lit("train")).otherwise(F.col("split"))).select(*df.columns)


def sample_per_class(df: DataFrame, cap: int, by: str = "label", seed: int = SEED) -> DataFrame:
    """Up to `cap` rows of each class."""
    return first_rows(df, [by], shuffle_key(seed), shuffle_bucket(seed), cap)


def balanced_binary(df: DataFrame, benign: int = 50_000, attack: int = 50_000, seed: int = SEED) -> DataFrame:
    """min(n, available) rows of class 0 and of class 1; adds `target`."""
    rows = df.withColumn("target", binary_label(F.col("label")))
    tagged = rows.withColumn("__want", F.when(F.col("target") == 0, benign).otherwise(attack))
    cuts_of = ["target", "__want"]
    key, bucket = shuffle_key(seed), shuffle_bucket(seed)
    if benign == attack:
        return first_rows(rows, ["target"], key, bucket, benign)
    cuts = quota_cuts(tagged, cuts_of, key, bucket, {"q": lambda n: F.col("__want")})
    return tagged.join(checked_small(cuts), cuts_of).filter(within_cut("q", key)).select(*rows.columns)


def specialist_training_set(
    df: DataFrame, classes: list[str], benign_cap: int = 30_000, class_cap: int = 10_000, seed: int = SEED
) -> DataFrame:
    """BENIGN up to one cap, every specialist class up to another; classes not present add nothing."""
    caps = inline_table(df.sparkSession, [("BENIGN", benign_cap)] + [(c, class_cap) for c in classes], ["label", "cap"])
    pool = df.join(F.broadcast(caps), "label")
    key, bucket = shuffle_key(seed), shuffle_bucket(seed)
    cuts = quota_cuts(pool, ["label", "cap"], key, bucket, {"q": lambda n: F.col("cap")})
    return pool.join(checked_small(cuts), ["label", "cap"]).filter(within_cut("q", key)).select(*df.columns)


def benign_only(df: DataFrame, cap: int = 150_000, seed: int = SEED) -> DataFrame:
    return first_rows(df.filter(F.col("label") == "BENIGN"), ["label"], shuffle_key(seed), shuffle_bucket(seed), cap)


def stratified_split(df: DataFrame, test: float = 0.2, valid: float = 0.2, seed: int = SEED) -> DataFrame:
    """Per class: the first 20 % to test, then 20 % of the rest to valid, the rest to train.

    Class sizes are rounded half up, each class on its own.
    """

    def tested(n: Column) -> Column:
        return F.floor(n * F.lit(test) + F.lit(0.5))

    def held(n: Column) -> Column:
        return tested(n) + F.floor((n - tested(n)) * F.lit(valid) + F.lit(0.5))

    key = shuffle_key(seed)
    cuts = quota_cuts(df, ["label"], key, shuffle_bucket(seed), {"t": tested, "v": held})
    split = F.when(within_cut("t", key), "test").when(within_cut("v", key), "valid").otherwise("train")
    return df.join(checked_small(cuts), "label").withColumn("split", split).select(*[c for c in df.columns if c != "split"], "split")


def class_weights(df: DataFrame, given: dict[str, float] | None = None) -> DataFrame:
    """Row count and weights per class: balanced n/(k x n_c), specialist max/n_c; and the
    ratio of benign to attack rows used as positive weight. `given` adds a column of fixed
    weights, by label or for all attacks under "ATTACK"; a class without one has 1."""
    counts = df.groupBy("label").count()
    whole = counts.agg(
        F.sum("count").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.max("count").alias("top"),
        F.sum(F.when(is_attack(F.col("label")), F.col("count")).otherwise(0)).alias("attacks"),
    )
    fixed_one = []
    if given is not None:
        own = F.lit(None).cast("double")
        for label, weight in given.items():
            own = F.when(F.col("label") == label, float(weight)).otherwise(own)
        attack = F.when(is_attack(F.col("label")), float(given["ATTACK"])) if "ATTACK" in given else F.lit(None).cast("double")
        fixed_one = [F.coalesce(own, attack, F.lit(1.0)).alias("fixed_weight")]
    return counts.crossJoin(whole).select(  # one row
        "label",
        *fixed_one,
        F.col("count").alias("n_rows"),
        (F.col("n") / (F.col("k") * F.col("count"))).alias("balanced_weight"),
        (F.col("top") / F.col("count")).alias("specialist_weight"),
        F.try_divide((F.col("n") - F.col("attacks")).cast("double"), F.col("attacks").cast("double")).alias("positive_weight"),
    )


def with_balanced_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Each row with n/(k x n_c) of its class."""
    counts = df.groupBy(label).count()
    whole = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"))
    weights = counts.crossJoin(whole).select(label, (F.col("n") / (F.col("k") * F.col("count"))).alias(out))
    return df.join(checked_small(weights), label)


def augmentation_plan(df: DataFrame, weak_below: int = 1000, target: int = 1500) -> DataFrame:
    """Weak classes and how many rows each lacks."""
    counts = df.groupBy("label").count().filter(F.col("count") < weak_below)
    lack = F.greatest(F.lit(0), F.lit(target) - F.col("count"))
    return counts.select(
        "label", F.col("count").alias("real_count"), lack.alias("synth_count"),
        (F.col("count") + lack).alias("total_count"), F.lit("success").alias("status"),
    ).filter(F.col("synth_count") > 0)
