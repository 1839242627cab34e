"""Streams against the batch operators: disorder, repeats, restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from flowlark.operators import incidents as I
from flowlark.session import folder_names
from flowlark.streaming import incidents as SI
from flowlark.streaming.correlate import counters_stream
from flowlark.streaming.run import drain_to_parquet
from tests.test_rules_of_meaning import ALERT


def alert_rows(n=120):
    start = dt.datetime(2024, 1, 1)
    return [
        (f"a{i}", i, start + dt.timedelta(seconds=17 * i), f"s{i % 2}", "d", "n", ("Bot", "DDoS", "PortScan")[i % 3], "high", 60 + i % 7)
        for i in range(n)
    ]


def test_incidents_from_a_stream_with_repeats(spark, tmp_path):
    rows = alert_rows()
    random.Random(1).shuffle(rows)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:50], rows[40:90], rows[30:]):
        spark.createDataFrame(part, ALERT).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], ALERT).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    SI.write_incident_updates(SI.incident_updates(stream, 7), out, str(tmp_path / "check"))
    want = I.incidents(spark.createDataFrame(rows, ALERT), 7)
    got = SI.current_incidents(spark, out).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_alerts_after_the_retention_do_not_reopen(spark, tmp_path):
    schema = spark.createDataFrame([], ALERT).schema
    early = alert_rows(3)
    later = [("z", 900, dt.datetime(2024, 1, 1, 9), "s9", "d", "n", "Bot", "high", 70)]
    more = [("y", 902, dt.datetime(2024, 1, 1, 9, 1), "s9", "d", "n", "Bot", "high", 70)]  # late rows are told one batch later
    again = [("old", 901, dt.datetime(2024, 1, 1, 0, 0, 5), "s0", "d", "n", "Bot", "high", 99)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (early, later, more, again):
        spark.createDataFrame(part, ALERT).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    SI.write_incident_updates(SI.incident_updates(stream), out, str(tmp_path / "check"))
    assert SI.current_incidents(spark, out).agg(F.max("severity_score")).first()[0] == 70


def test_compaction_bounds_the_files_read(spark, tmp_path):
    rows = alert_rows(130)
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = spark.createDataFrame([], ALERT).schema

    def run(parts):
        for part in parts:
            spark.createDataFrame(part, ALERT).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        SI.write_incident_updates(SI.incident_updates(stream, 7), out, check, compact_every=3)

    run([rows[i : i + 10] for i in range(0, 60, 10)])
    run([rows[i : i + 10] for i in range(60, 130, 10)])
    names = folder_names(spark, out)
    assert len([n for n in names if n.startswith("epoch=")]) <= 6 and len(folder_names(spark, f"{out}/base")) <= 2
    want = I.incidents(spark.createDataFrame(rows, ALERT), 7)
    got = sorted(map(str, SI.current_incidents(spark, out).select(*want.columns).collect()))
    assert got == sorted(map(str, want.collect()))
    last = max(int(n.removeprefix("upto=")) for n in folder_names(spark, f"{out}/base"))
    SI.compact_incidents(spark, out, last)  # a repeated compaction
    spark.createDataFrame([], want.schema).write.mode("overwrite").parquet(f"{out}/base/upto={last + 90}")
    (tmp_path / "out" / "base" / f"upto={last + 90}" / "_SUCCESS").unlink()  # a base whose write was cut off
    assert sorted(map(str, SI.current_incidents(spark, out).select(*want.columns).collect())) == got


def test_a_reader_that_has_begun_outlives_one_compaction(spark, tmp_path):
    out = str(tmp_path / "out")
    one = I.incidents(spark.createDataFrame(alert_rows(20), ALERT), 7)
    for epoch in range(4):
        one.write.parquet(f"{out}/epoch={epoch}")
        if epoch == 1:
            SI.compact_incidents(spark, out, 1)
    begun = SI.current_incidents(spark, out)
    SI.compact_incidents(spark, out, 3)
    assert begun.count() == one.count() == SI.current_incidents(spark, out).count()


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "mode string, binary_label string"

    def add(n):
        spark.createDataFrame([("network", "BENIGN")] * n, schema).coalesce(1).write.mode("append").parquet(folder)

    add(3)
    rows = spark.readStream.schema(schema).parquet(folder)
    assert drain_to_parquet(rows, out, check).count() == 3
    add(4)
    assert drain_to_parquet(rows, out, check).count() == 7
    assert counters_stream(spark.read.parquet(out)).first()["benign_count"] == 7
