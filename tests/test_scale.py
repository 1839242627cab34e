"""Exact ranks, quantiles, newest rows and running totals against plain Python, on skewed data."""

import random

import numpy as np
from pyspark.sql import functions as F

from flowlark.operators import scale as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_quantile_with_heavy_tail_and_hot_value(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.random(500), np.full(400, 7.0), [1e12, -1e9, 3.5]])
    rows = [("a", float(v)) for v in values] + [("b", 2.0), ("b", 4.0), ("c", 5.0), ("c", None)]
    df = frame(spark, rows, "g string, v double")
    for q in (0.0, 0.05, 0.37, 0.5, 0.99, 1.0):
        got = {r["g"]: r["quantile"] for r in S.exact_quantile(df, ["g"], "v", q).collect()}
        assert np.isclose(got["a"], np.quantile(values, q), rtol=1e-12)
        assert got["b"] == 2.0 + 2.0 * q and got["c"] == 5.0


def test_quantile_without_group(spark):
    df = frame(spark, [(float(i),) for i in range(101)], "v double")
    assert S.exact_quantile(df, [], "v", 0.25).first()["quantile"] == 25.0


def test_order_statistics_of_whole_numbers(spark):
    big = 2**60
    df = frame(spark, [("a", big + i) for i in (3, 1, 2, 2, 9)], "g string, v bigint")
    found = S.order_statistics(df, ["g"], "v", lambda n: {f"p{i}": F.lit(i) for i in range(5)})
    got = {r["pos"]: (r["value"] - big, r["before"]) for r in found.collect()}
    assert got == {0: (1, 0), 1: (2, 1), 2: (2, 1), 3: (3, 3), 4: (9, 4)}


def test_order_statistics_of_any_doubles(spark, monkeypatch):
    rounds = []
    whole = S.settle
    monkeypatch.setattr(S, "settle", lambda df, *a: rounds.append(1) or whole(df, *a))
    values = [float("-inf"), float("inf"), -0.0, 0.0, 5e-324, 1e-300, 1e300, -1e300, 1.7e308, 1.0, 1.0000000000000002, -3.5, *(2.0**k for k in range(-40, 40)), *(1 + i * 1e-15 for i in range(60))]
    df = frame(spark, [(v,) for v in values], "v double")
    places = [0, 1, 2, 5, 40, 60, 75, 100, 130, len(values) - 1]
    found = S.order_statistics(df, [], "v", lambda n: {f"p{i}": F.lit(i) for i in places})
    assert {r["pos"]: r["value"] for r in found.collect()} == {i: sorted(values)[i] for i in places}
    assert len(rounds) <= 7  # the start and six rounds


def test_newest_rows_without_group_or_time(spark):
    df = frame(spark, [("x", 10, 1), (None, 20, 2), ("x", None, 3), ("x", 20, None), ("y", 5, 4)], "m string, s long, i long").withColumn("ts", F.timestamp_seconds("s"))
    assert [sorted(r["i"] for r in S.newest_rows(df, "m", "ts", "i", n).collect()) for n in (100, 101)] == [[1, 4], [1, 4]]


def test_newest_rows_with_ties(spark):
    random.seed(3)
    rows = [(m, random.choice([10, 20, 20, 30]), i) for i in range(2000) for m in ("x", "y") if m == "x" or i < 50]
    df = frame(spark, rows, "m string, s long, i long").withColumn("ts", F.timestamp_seconds("s"))
    for n in (7, 150, 1200):
        got = {(r["m"], r["i"]) for r in S.newest_rows(df, "m", "ts", "i", n).collect()}
        want = set()
        for m in ("x", "y"):
            mine = sorted((r for r in rows if r[0] == m), key=lambda r: (-r[1], -r[2]))[:n]
            want |= {(m, r[2]) for r in mine}
        assert got == want


def test_first_rows_takes_exact_numbers(spark):
    rows = [("hot" if i % 3 else "cold", f"id{i}") for i in range(3000)]
    df = frame(spark, rows, "g string, id string")
    key = F.md5("id")
    for quota in (0, 1, 999, 5000):
        got = S.first_rows(df, ["g"], key, F.substring(key, 1, 4), quota)
        sizes = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
        assert sizes == {g: n for g, n in (("hot", min(2000, quota)), ("cold", min(1000, quota))) if n}


def test_running_totals_with_crowded_bucket(spark):
    rng = np.random.default_rng(2)
    scores = sorted(set(rng.random(300)) | {0.5 + i * 1e-9 for i in range(300)})
    df = frame(spark, [(float(s), 1) for s in scores], "s double, n long")
    out = S.running_totals(df, F.col("s"), F.col("s") * 16, ["n"], rows_per_bucket=50)
    got = [r["cum_n"] for r in out.orderBy("s").collect()]
    assert got == list(range(1, len(scores) + 1))


def test_running_totals_cut_until_no_bucket_is_crowded(spark):
    scores = [0.5 + i * 1e-13 for i in range(2000)] + [i / 50 for i in range(50) if i != 25]
    df = frame(spark, [(s, 1) for s in scores], "s double, n long")
    out = S.running_totals(df, F.col("s"), F.col("s") * 16, ["n"], rows_per_bucket=100)
    assert [r["cum_n"] for r in out.orderBy("s").collect()] == list(range(1, len(scores) + 1))


def test_large_small_side_is_not_broadcast(spark):
    dim = spark.range(50).withColumnRenamed("id", "k")
    assert S.checked_small(dim, 10) is dim
    assert S.checked_small(dim, 50).count() == 50
