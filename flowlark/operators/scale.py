"""Exact ranks, quantiles and running totals that never put a whole group into one task.

All start from a histogram: a cheap map-side-combined count per (group, bucket). Its
running total tells how many rows lie before each bucket, so only single buckets need a
closer look.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.session import cut_lineage


BROADCAST_ROWS = 100_000


def checked_small(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A per-class or per-bucket frame ready for joining to wide rows.

    It is worked out once. Up to `max_rows` rows it comes back as a broadcast copy, so the
    wide side is not shuffled; beyond that it stays a plain frame and the join shuffles,
    with adaptive skew splitting for hot keys.
    """
    rows = dim.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return dim
    return F.broadcast(dim.sparkSession.createDataFrame(rows, schema=dim.schema))


def _offsets(tagged: DataFrame, group: list[str]) -> DataFrame:
    """Per (group, __b): rows in the bucket, rows before it, rows in the group."""
    sizes = tagged.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    per_group = Window.partitionBy(*group)
    before = per_group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *group,
        "__b",
        "__n",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(per_group).alias("__total"),
    )


def quota_cuts(
    df: DataFrame,
    group: list[str],
    key: Column,
    bucket: Column,
    quotas: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """For each group the key of its q-th row in key order, one column per quota.

    `bucket` must grow with `key`. A quota is a function of the group's row count.
    Columns: group..., total, and per quota `<name>_n` (the quota) and `<name>_cut`
    (null where the quota is below 1 or covers the whole group).
    """
    tagged = df.select(*group, key.alias("__key"), bucket.alias("__b"))
    offsets = _offsets(tagged, group)
    total = F.col("__total")
    wanted = F.lit(False)
    for quota in quotas.values():
        q = quota(total)
        wanted = wanted | ((q > F.col("__before")) & (q <= F.col("__before") + F.col("__n")) & (q < total))
    # One scan gives the buckets holding a cut and, from each group's first bucket, its size.
    known = settle(offsets.withColumn("__hit", wanted).filter(F.col("__hit") | (F.col("__before") == 0)))
    hit = known.filter("__hit").select(*group, "__b", "__before", "__total")
    inside = Window.partitionBy(*group, "__b").orderBy("__key")
    ranked = tagged.join(hit, [*group, "__b"]).withColumn("__rank", F.col("__before") + F.row_number().over(inside))
    cuts = ranked.groupBy(*group).agg(
        *[
            F.max(F.when(F.col("__rank") == quota(F.col("__total")), F.col("__key"))).alias(f"{name}_cut")
            for name, quota in quotas.items()
        ]
    )
    totals = known.groupBy(*group).agg(F.max("__total").alias("total"))
    totals = totals.select("*", *[quota(F.col("total")).alias(f"{name}_n") for name, quota in quotas.items()])
    if not group:
        return totals.crossJoin(cuts)  # one row each
    return totals.join(cuts, group, "left")


def within_cut(name: str, key: Column) -> Column:
    """True for rows among the first `<name>_n` of their group."""
    quota, cut = F.col(f"{name}_n"), F.col(f"{name}_cut")
    return F.when(quota >= F.col("total"), F.lit(True)).when(quota <= 0, F.lit(False)).otherwise(key <= cut)


def first_rows(
    df: DataFrame,
    group: list[str],
    key: Column,
    bucket: Column,
    quota: int | Callable[[Column], Column],
) -> DataFrame:
    """The first `quota` rows of every group in key order. Rows with a missing group go.

    The wide rows are never shuffled: they only meet one small row per group.
    """
    rule = quota if callable(quota) else (lambda total: F.lit(quota))
    cuts = quota_cuts(df, group, key, bucket, {"q": rule})
    joined = df.join(checked_small(cuts), group) if group else df.crossJoin(cuts)
    return joined.filter(within_cut("q", key)).select(*[F.col(c) for c in df.columns])


def settle(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Works a small frame out once: a broadcast copy up to `max_rows`, else a checkpoint."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))
    return cut_lineage(df)


def magnitude(v: Column) -> Column:
    """A number that grows with a double over its whole range: exponent plus fraction, 0 for zero, beyond all others for infinities."""
    size = F.abs(v)
    power = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1074)).cast("double")
    fraction = F.greatest(F.least(size / F.pow(F.lit(2.0), power) - 1, F.lit(1.0)), F.lit(0.0))
    found = F.when(size == 0, 0.0).when(size == float("inf"), 3000.0).otherwise(power + 1080 + fraction)
    return F.when(v < 0, -found).otherwise(found)


def share_between(v: Column, lo: Column, hi: Column, real: bool, ends: tuple[Column, Column] | None = None) -> Column:
    """How far v lies from lo to hi, never falling as v grows; `ends` are the magnitudes of lo and hi where they are known.

    Doubles go by magnitude until lo and hi agree in it to the last bits, and then by value; with 4,096
    buckets six rounds are enough for any doubles. Whole numbers go by difference.
    """
    if real:
        v, lo, hi = (x.cast("double") for x in (v, lo, hi))
        low, high = ends or (magnitude(lo), magnitude(hi))
        return F.when(high - low > 1e-9, (magnitude(v) - low) / (high - low)).otherwise(F.try_divide(v - lo, hi - lo))
    wide = hi.cast("double") - lo.cast("double")
    return F.when(wide > 1e15, (v.cast("double") - lo.cast("double")) / wide).otherwise(F.try_divide((v - lo).cast("double"), (hi - lo).cast("double")))


def order_statistics(
    df: DataFrame, group: list[str], value: str, positions: Callable[[Column], dict[str, Column]], buckets: int = 4096, extra: DataFrame | None = None
) -> DataFrame:
    """The values at given 0-based positions of each group's sorted values, without sorting.

    Rows with a missing or NaN value, or a missing group, do not count.
    `positions` names positions from the group's number of values, and from columns of
    `extra` (one row per group) if given. Each round counts the rows between the two values known
    to enclose a position, in buckets of equal width (`share_between`), and keeps the bucket holding
    it, until one value is left: at most six rounds. A round is one scan with a map-side-combined count; even when almost
    all rows share a bucket, or a value, no task gets them.
    Columns of the result: group..., name, pos, value, before (rows with a smaller value), total.
    """
    data = df.select(*group, F.col(value).alias("__v"))
    for name in group:
        data = data.filter(F.col(name).isNotNull())
    real = isinstance(data.schema["__v"].dataType, (T.DoubleType, T.FloatType))
    data = data.filter(F.col("__v") <= float("inf") if real else F.col("__v").isNotNull())  # NaN sorts above infinity
    span = data.groupBy(*group).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count(F.lit(1)).alias("total")).filter("total > 0")
    if extra is not None:
        span = span.join(extra, group)
    places = [F.struct(F.lit(name).alias("name"), pos.cast("bigint").alias("pos")) for name, pos in positions(F.col("total")).items()]
    names = [*group, "name", "pos", "lo", "hi", "before", "total"]
    start = span.select(*group, "lo", "hi", "total", F.explode(F.array(*places)).alias("e"))
    targets = settle(start.select(*group, "e.*", "lo", "hi", "total", F.lit(0).cast("bigint").alias("before")).select(*names))
    while not targets.filter(F.col("lo") < F.col("hi")).isEmpty():
        open_ones = targets.filter(F.col("lo") < F.col("hi"))
        # Positions between the same two values are counted together, and the ends' magnitudes are taken here, not for each row.
        ends = [magnitude(F.col(c).cast("double")).alias(f"__{c}_size") for c in ("lo", "hi")] if real else []
        spans = settle(open_ones.select(*group, F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), *ends).distinct())
        inside = data.join(spans, group) if group else data.crossJoin(spans)
        inside = inside.filter((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
        sizes = (F.col("__lo_size"), F.col("__hi_size")) if real else None
        share = share_between(F.col("__v"), F.col("__lo"), F.col("__hi"), real, sizes)
        at = F.when(F.col("__v") == F.col("__hi"), buckets).otherwise(
            F.least(F.floor(F.nanvl(F.coalesce(share, F.lit(0.0)), F.lit(0.0)) * buckets), F.lit(buckets - 1))
        )
        counts = inside.groupBy(*group, "__lo", "__hi", at.alias("__b")).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most")
        )
        earlier = Window.partitionBy(*group, "__lo", "__hi").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("__less", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        known = open_ones.withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
        both = placed.join(known, [*group, "__lo", "__hi"]).withColumn("before", F.col("before") + F.col("__less"))
        found = both.filter((F.col("before") <= F.col("pos")) & (F.col("pos") < F.col("before") + F.col("__n")))
        found = found.withColumnsRenamed({"__least": "lo", "__most": "hi"})
        targets = settle(targets.filter(F.col("lo") >= F.col("hi")).unionByName(found.select(*names)))
    return targets.select(*group, "name", "pos", F.col("lo").alias("value"), "before", "total")


def exact_quantile(df: DataFrame, group: list[str], value: str, q: float, out: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile per group, exact, without a per-group value map or sort."""
    rows = df.select(*group, F.col(value).cast("double").alias("v"))

    def at(n: Column) -> Column:
        return (n - 1).cast("double") * F.lit(q)

    found = order_statistics(rows, group, "v", lambda n: {"low": F.floor(at(n)), "high": F.ceil(at(n))})
    low, high = (F.max(F.when(F.col("name") == name, F.col("value"))) for name in ("low", "high"))
    part = at(F.max("total")) - F.floor(at(F.max("total")))
    return found.groupBy(*group).agg((low + (high - low) * part).alias(out))


def newest_rows(df: DataFrame, group: str, ts: str, tie: str, n: int) -> DataFrame:
    """The n rows of each group with the greatest (ts, tie); `tie` is unique within equal times.

    Rows with a missing group, time or tie go, whatever n. Few rows are found by a partial limit in
    every task; more by searching the cut; the rows are the same either way.
    """
    rows = df.filter(F.col(group).isNotNull() & F.col(ts).isNotNull() & F.col(tie).isNotNull())
    if n <= 100:
        order = Window.partitionBy(group).orderBy(F.col(ts).desc(), F.col(tie).desc())
        return rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).select(*df.columns)
    age, number = -F.unix_micros(F.col(ts).cast("timestamp")), -F.col(tie)
    found = order_statistics(rows.select(group, age.alias("age")), [group], "age", lambda c: {"cut": F.least(c, F.lit(n)) - 1})
    cut = settle(found.select(group, F.col("value").alias("__age"), (F.col("pos") - F.col("before")).alias("__more")))
    level = rows.join(cut, group).filter(age == F.col("__age")).select(group, number.alias("number"))
    ties = order_statistics(level, [group], "number", lambda c: {"cut": F.col("__more")}, extra=cut.select(group, "__more"))
    last = settle(ties.select(group, F.col("value").alias("__number")))
    joined = rows.join(cut, group).join(last, group)
    return joined.filter((age < F.col("__age")) | ((age == F.col("__age")) & (number <= F.col("__number")))).select(*df.columns)


def running_totals(df: DataFrame, order: Column, scaled: Column, values: list[str], rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Adds `cum_<v>`: the sum of v over all rows up to this one in order (unique keys).

    `scaled` is a number growing with the order; its whole part is the row's bucket. Buckets with
    too many rows are cut 4,096 times finer between their least and greatest order, again and
    again until none has too many. Bucket sums are added up level by level: a task gets the top
    buckets, or the parts of one bucket of the level above; rows are added up only inside their bucket.
    """
    tagged = df.withColumns({"__o": order.cast("double"), "__b0": F.floor(scaled).cast("bigint")})
    levels = ["__b0"]
    while True:
        sizes = tagged.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), F.min("__o").alias("__lo"), F.max("__o").alias("__hi"))
        crowded = settle(sizes.filter((F.col("n") > rows_per_bucket) & (F.col("__lo") < F.col("__hi"))).drop("n"))
        if crowded.isEmpty():
            break
        share = share_between(F.col("__o"), F.col("__lo"), F.col("__hi"), True)
        place = F.when(F.col("__lo").isNull(), 0).when(F.col("__o") == F.col("__hi"), 4096).otherwise(F.least(F.floor(share * 4096), F.lit(4095)))
        name = f"__b{len(levels)}"
        tagged = cut_lineage(tagged.join(crowded, levels, "left").withColumn(name, place.cast("bigint")).drop("__lo", "__hi"))
        levels = [*levels, name]
    sums = cut_lineage(tagged.groupBy(*levels).agg(*[F.sum(v).alias(f"__p_{v}") for v in values]))
    base = sums.select(*levels, *[(F.col(f"__p_{v}") * 0).alias(f"__p_{v}") for v in values])
    for depth in range(len(levels)):
        upper, own = levels[:depth], levels[: depth + 1]
        level = sums.groupBy(*own).agg(*[F.sum(f"__p_{v}").alias(f"__s_{v}") for v in values])
        earlier = Window.partitionBy(*(upper or [F.lit(0)])).orderBy(levels[depth]).rowsBetween(Window.unboundedPreceding, -1)
        before = level.select(*own, *[F.coalesce(F.sum(f"__s_{v}").over(earlier), F.lit(0)).alias(f"__e_{v}") for v in values])
        base = base.join(before, own).select(*levels, *[(F.col(f"__p_{v}") + F.col(f"__e_{v}")).alias(f"__p_{v}") for v in values])
    inside = Window.partitionBy(*levels).orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.join(checked_small(base), levels)
        .select(*df.columns, *[(F.col(f"__p_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}") for v in values])
    )
