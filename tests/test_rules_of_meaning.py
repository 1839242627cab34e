
import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.functions.expr import minute_bucket, parse_time, round_exact
from flowlark.operators import alerts as D
from flowlark.operators import clean as P
from flowlark.operators import correlate as C
from flowlark.operators import evaluate as E
from flowlark.operators import incidents as I
from flowlark.operators import joins as J
from flowlark.operators import profile as A
from flowlark.operators import sampling as B
from flowlark.operators import timeseries as R
from flowlark.sources import flow_files as S

PRED = "ts timestamp, src_ip string, dst_ip string, dst_port int, protocol string, predicted_label string, confidence double"


def at(second, minute=0, micro=0):
    return dt.datetime(2024, 1, 1, 0, minute, second, micro)


def predictions(spark, rows):
    return spark.createDataFrame(rows, PRED)


def test_groups_drop_missing_keys_but_raw_counts_them(spark):
    rows = [(at(i), "s", "d", 80 + i % 2, "TCP", "DDoS", 0.5) for i in range(3)]
    rows += [(at(9), None, "d", 80, "TCP", "DDoS", 0.5), (at(9), "s", "d", 80, "TCP", None, 0.5), (at(9), "s", "d", 80, "TCP", "BENIGN", 0.5)]
    df = predictions(spark, rows)
    events = C.correlate_alerts(df).collect()
    assert [(e["src_ip"], e["alert_count"], e["dst_ports"], e["severity"]) for e in events] == [("s", 3, [80, 81], "MEDIUM")]
    n = C.noise_reduction(df).first()
    assert (n["raw_alerts"], n["suppressed_groups"], n["correlated_events"]) == (5, 0, 1)
    assert n["noise_reduction_pct"] == pytest.approx(80.0)


def test_count_severity_edges(spark):
    got = spark.createDataFrame([(n,) for n in (0, 2, 3, 9, 10, 24, 25, 900)], "n int").select(C.count_severity(F.col("n")).alias("s"))
    assert [r["s"] for r in got.collect()] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]


def test_no_attacks_gives_an_empty_frame_with_columns(spark):
    df = predictions(spark, [(at(1), "s", "d", 80, "TCP", "BENIGN", 0.5)])
    out = C.correlate_alerts(df)
    assert out.count() == 0 and "tactic" in out.columns
    assert C.noise_reduction(df).first()["noise_reduction_pct"] == 100.0


def test_unknown_label_gets_unknown_mitre(spark):
    row = J.mitre_enrich(spark.createDataFrame([("Odd",)], "predicted_label string")).first()
    assert (row["mitre_id"], row["technique"], row["tactic"]) == fixed.UNKNOWN_MITRE


def test_two_mitre_mappings_stay_apart(spark):
    df = spark.createDataFrame([("PortScan",)], "predicted_label string")
    assert J.mitre_enrich(df).first()["tactic"] == "Discovery"
    assert J.mitre_playbook(df, "predicted_label").first()["mitre"]["tactics"][0]["name"] == "Reconnaissance"


def test_bucket_starts_anew_each_hour(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5, 59, 59),), (dt.datetime(2024, 1, 1, 6, 0, 1),)], "t timestamp")
    got = [r["b"] for r in df.select(minute_bucket(F.col("t"), 7).alias("b")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 5, 56), dt.datetime(2024, 1, 1, 6, 0)]


MODEL = "row_index int, binary_prediction int, binary_confidence double, multiclass_label string, multiclass_confidence double, anomaly_flag int, anomaly_score double"


def test_severity_cuts_toward_zero_and_stays_in_range(spark):
    rows = [(0, 0, 0.59, "x", 0.5, 0, -0.39), (1, 1, 0.99, "DDoS", 0.5, 1, 0.9), (2, 0, 0.0, "x", 0.5, 1, -30.0)]
    df = spark.createDataFrame(rows, MODEL)
    kinds = F.when(F.col("row_index") == 1, "DDoS").otherwise("Odd")
    # 55 + 5 - 1 = 59; 95 + 9 + 4 + 5 is over 100; 55 - 150 + 5 is below 0
    assert [r["s"] for r in df.select(D.severity_score(kinds).alias("s")).collect()] == [59, 100, 0]


def test_attack_type_and_reasons(spark):
    rows = [
        (0, 1, 0.9, "BENIGN", 0.5, 0, 0.1), (1, 1, 0.9, "", 0.5, 0, 0.1), (2, 1, 0.125, "Bot", 0.5, 1, 0.125), (3, 0, 0.9, "Bot", 0.5, 1, 0.1),
        (4, 0, 0.9, "Bot", 0.5, 0, 0.1), (5, 1, 0.9, None, 0.5, 0, 0.1),
    ]
    df = spark.createDataFrame(rows, MODEL).withColumn("kind", D.resolve_attack_type()).withColumn("why", D.reasoning(F.col("kind")))
    got = {r["row_index"]: (r["kind"], r["why"]) for r in df.collect()}
    assert [got[i][0] for i in range(6)] == ["SUSPICIOUS_ACTIVITY", "SUSPICIOUS_ACTIVITY", "Bot", "UNKNOWN_ANOMALY", "BENIGN", "SUSPICIOUS_ACTIVITY"]
    assert len(got[2][1]) == 3 and got[2][1][2].endswith("with score 0.12.")  # an exact tie goes to the even digit
    assert got[4][1] == ["The flow stayed below alerting thresholds."]


def test_alert_defaults(spark):
    rows = [(0, 1, 0.9, "Bot", 0.5, 0, 0.1, " ", None, "2024-01-01T02:00:00+02:00", None), (1, 1, 0.9, "Bot", 0.5, 0, 0.1, "10.0.0.1", "f9", "no date", "s1")]
    df = spark.createDataFrame(rows, MODEL + ", src_ip string, flow_id string, timestamp string, sensor_id string")
    late = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    got = {a["row_index"]: a for a in D.build_alerts(df, F.lit("b"), late).collect()}
    assert (got[0]["source_ip"], got[0]["destination_ip"], got[0]["flow_id"], got[0]["sensor_id"]) == ("unknown", "unknown", "flow-0", "unspecified")
    assert got[0]["timestamp"] == dt.datetime(2024, 1, 1) and got[1]["timestamp"] == dt.datetime(2024, 2, 1)
    assert got[1]["flow_id"] == "f9" and got[0]["alert_id"] != got[1]["alert_id"]


ALERT = "alert_id string, row_index int, timestamp timestamp, source_ip string, destination_ip string, sensor_id string, attack_type string, severity string, severity_score int"


def test_highest_severity_tie_goes_to_the_earliest(spark):
    rows = [("a", 5, at(20), "s", "d", "n", "Bot", "high", 80), ("b", 6, at(10), "s", "d", "n", "PortScan", "high", 80), ("c", 4, at(10), "s", "d", "n", "DDoS", "high", 80)]
    row = I.incidents(spark.createDataFrame(rows, ALERT)).first()
    assert row["primary_attack_type"] == "DDoS"  # same time as PortScan, earlier row
    assert (row["alert_count"], row["suppressed_duplicates"], row["attack_types"]) == (3, 0, ["Bot", "DDoS", "PortScan"])
    assert [s["phase"] for s in row["mitre_attack_steps"]] == ["Reconnaissance", "Command and Control", "Impact"]


def test_progression_drops_doubles_and_puts_triage_last(spark):
    types = F.array(*[F.lit(t) for t in ("Heartbleed", "Infiltration", "UNKNOWN_ANOMALY", "WebAttack_SQLInjection", "Zzz")])
    steps = spark.range(1).select(I.attack_progression(types).alias("s")).first()["s"]
    assert [s["step"] for s in steps] == list(range(1, len(steps) + 1))
    assert steps[-1]["phase"] == "Triage" and sum(s["phase"] == "Triage" for s in steps) == 1
    assert [s["phase"] for s in steps[:3]] == ["Initial Access"] * 3


def test_window_must_be_positive(spark):
    with pytest.raises(ValueError):
        I.incidents(spark.createDataFrame([], ALERT), 0)


def test_upsert_is_the_same_in_one_or_many_batches(spark):
    rows = [(f"a{i}", i, at(i % 60, i // 60), f"s{i % 3}", "d", "n", "Bot" if i % 2 else "DDoS", "high", 70 + i % 9) for i in range(200)]
    df = spark.createDataFrame(rows, ALERT)
    once = I.incidents(df).orderBy("incident_id").collect()
    many = df.limit(120).unionByName(df).unionByName(df.filter("row_index > 30"))
    assert I.upsert_incidents(many).orderBy("incident_id").collect() == once


def test_label_fixes(spark):
    raw = [k for k in fixed.LABEL_FIXES] + ["  DDoS ", None]
    got = [r["label"] for r in P.clean_labels(spark.createDataFrame([(x,) for x in raw], "label string")).collect()]
    assert got == list(fixed.LABEL_FIXES.values()) + ["DDoS", None]


def test_clean_numeric(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0, "a"), (inf, "b"), (-inf, "c"), (nan, "d"), (None, "e"), (2.0, None)], "x double, y string")
    assert [tuple(r) for r in P.clean_numeric(df).collect()] == [(1.0, "a")]
    assert tuple(P.clean_numeric_report(df).first()) == (6, 1, 5)


def test_normalize_defaults_and_refusals(spark):
    df = spark.createDataFrame([("-3.9", None, "icmp"), ("x", "nan", None), ("1e3", "2.5", "udp")], "src_port string, duration string, protocol string")
    got = P.normalize_flow(df, F.lit("now")).collect()
    assert [r["src_port"] for r in got] == [-3, None, 1000]
    assert [r["protocol"] for r in got] == ["ICMP", "TCP", "UDP"]
    assert [r["rejected"] for r in got] == [[], ["src_port"], []]
    assert got[0]["dst_ip"] == "192.168.1.1" and got[0]["tcp_flags"] == "SYN" and got[0]["total_bytes"] == 0 and got[0]["timestamp"] == "now"


def test_parse_time(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00", "2024-01-01 00:00:00", "", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    late = dt.datetime(2025, 1, 1)
    got = [r["x"] for r in df.select(parse_time(F.col("t"), F.to_timestamp(F.lit("2025-01-01"))).alias("x")).collect()]
    assert got == [dt.datetime(2024, 1, 1)] * 3 + [late] * 3


def test_round_exact(spark):
    values = [0.125, 2.675, -0.0049, 71.72455, 1234567.891]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(round_exact(F.col("v"), 2).alias("r"))
    assert [r["r"] for r in df.collect()] == [round(v, 2) for v in values]


def test_batches_are_refused_for_the_right_reason(spark):
    texts = ['{"flows": 7}', '{"flows": null}', '{"flows": []}', "{}", '{"flows": [{"a": 1}]}', '{"flows": [1, 2, 3]}']
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    got = [r["reason"] for r in S.batch_validate(df, limit=2).collect()]
    array, none, big = "'flows' must be a JSON array.", "'flows' must contain at least one entry.", "Batch too large. Maximum 2 flows per request."
    assert got == [array, array, none, none, None, big]


def test_default_window_of_a_batch(spark):
    texts = ['{"flows": [{"src_ip": "a", "src_port": 80}]}', '{"flows": [{"src_ip": "b"}], "correlation_window_minutes": 7}']
    got = S.flow_batches(spark.createDataFrame([(t,) for t in texts], "payload string"), []).orderBy("src_ip").collect()
    assert [(r["src_ip"], r["src_port"], r["window_minutes"], r["row_index"]) for r in got] == [("a", "80", 5, 0), ("b", None, 7, 0)]


def test_report_and_dashboard_read_the_table_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 23, 58, 0, 250_000)
    labels = ("BENIGN", "Bot", None, "unclassified")
    rows = [(("simulator", "network", "other")[i % 3], start + dt.timedelta(milliseconds=700 * i), labels[i % 4], i % 5 or None) for i in range(400)]
    rows += [("network", None, "Bot", 7)]
    folder, as_of = str(tmp_path / "flows"), "2024-01-02 00:02:10.9"
    spark.createDataFrame(rows, "mode string, received_at timestamp, attack_label string, total_packets int").write.parquet(folder)
    df = spark.read.parquet(folder)
    alone = {
        "packet_activity": R.poll_activity(df, as_of, 2.5), "per_second": R.packets_per_second(df, as_of), "per_minute": R.packets_per_minute(df, as_of),
        "per_hour": R.packets_per_hour(df, as_of), "per_day": R.packets_per_day(df, as_of),
    }
    bundle, board = R.report_bundle(df, as_of, None, None, 2.5), R.dashboard_snapshot(df, as_of, 2.5)
    for out in (bundle, board):
        assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
    got = bundle.collect()
    for name, series in alone.items():
        assert sorted((r["position"], r["x"], r["y"]) for r in got if r["section"] == name) == sorted(tuple(r) for r in series.collect())
    assert {(r["x"], r["y"]) for r in got if r["section"] == "attack_counts"} == {tuple(r) for r in R.attack_counts(df.filter("received_at is not null")).collect()}  # undated rows are in no range
    days = {(r["section"], r["x"], r["y"]) for r in got if r["section"].startswith("day ")}
    assert days == {(f"day {r['day']} {r['kind']}", r["key"], r["value"]) for r in R.daily_report(df).collect()}
    network = df.filter("mode = 'network'")
    seen = {(r["x"], r["y"]) for r in board.collect() if r["mode"] == "network" and r["section"] == "summary"}
    benign = network.filter("attack_label = 'BENIGN'").count()
    other = network.filter("attack_label is null or attack_label not in ('BENIGN', 'unclassified')").count()
    assert seen == {("total_flows", network.count()), ("benign_count", benign), ("not_benign_count", other)}


def test_csv_jobs_follow_headers_not_files(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"f{i:02d}.csv").write_text(("\n x ,Label\n" if i % 3 else "Label,x\n") + (f"{i},Bot\n" if i % 3 else f"Bot,{i}\n"))
    (tmp_path / "none.csv").write_text("")
    names = sorted(str(p) for p in tmp_path.iterdir())
    groups = S.files_by_header(spark, names)
    assert sorted(len(g) for g in groups.values()) == [4, 8]
    got = sorted((r["x"], r["Label"], r["source_file"]) for r in S.ingest_csv(spark, str(tmp_path), "cic").collect())
    assert got == sorted((str(i), "Bot", f"f{i:02d}.csv") for i in range(12))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("\n")
    assert S.ingest_csv(spark, str(tmp_path / "empty"), "cic").columns == ["source_file", "dataset"]


def test_csv_files_keep_their_names(spark, tmp_path):
    (tmp_path / "b.csv").write_text(" x ,Label\n1,BENIGN\nInfinity,DDoS\n")
    (tmp_path / "a.csv").write_text("Label, x \nBot,3\n")
    from pyspark.sql import types as T

    kinds = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("Label", T.StringType())])
    got = {tuple(r) for r in S.ingest_csv(spark, str(tmp_path), "cic", kinds).select("x", "Label", "source_file", "dataset").collect()}
    assert got == {(1.0, "BENIGN", "b.csv", "cic"), (float("inf"), "DDoS", "b.csv", "cic"), (3.0, "Bot", "a.csv", "cic")}


def labelled(spark, n=1000):
    rows = [(f"r{i}", "BENIGN" if i % 2 else "DDoS" if i % 10 else "Rare", ("train", "valid", "test")[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id string, label string, split string")


def test_seeding_moves_at_least_one_row_per_class(spark):
    df = labelled(spark)
    before = {(r["label"], r["split"]): r["count"] for r in df.groupBy("label", "split").count().collect()}
    after = {(r["label"], r["split"]): r["count"] for r in B.seed_attacks(df, 0.001).groupBy("label", "split").count().collect()}
    for label, moved in (("BENIGN", 0), ("DDoS", 1), ("Rare", 1)):
        assert after[label, "valid"] == before[label, "valid"] - moved and after[label, "train"] == before[label, "train"] + moved
    assert B.seed_attacks(df.filter("label = 'BENIGN'")).count() == 500


def test_splits_are_whole_and_apart(spark):
    df = labelled(spark).drop("split")
    out = B.stratified_split(df)
    sizes = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert (sizes["BENIGN", "test"], sizes["BENIGN", "valid"], sizes["BENIGN", "train"]) == (100, 80, 320)
    assert out.count() == 1000 and out.select("row_id").distinct().count() == 1000
    again = B.stratified_split(df.repartition(7)).orderBy("row_id").collect()
    assert again == out.orderBy("row_id").collect()


def test_weights(spark):
    got = {r["label"]: r for r in B.class_weights(labelled(spark)).collect()}
    assert got["Rare"]["balanced_weight"] == pytest.approx(1000 / (3 * 100)) and got["Rare"]["specialist_weight"] == 5.0
    assert got["BENIGN"]["positive_weight"] == 1.0


def test_unfit_labels_stay_when_rare_ones_merge(spark):
    df = labelled(spark).unionByName(spark.createDataFrame([("n", "New", "test")], "row_id string, label string, split string"))
    got = {r["label"] for r in P.rare_label_merge(df, F.col("split") == "train", 100).select("label").distinct().collect()}
    assert got == {"BENIGN", "DDoS", "OtherAttack", "New"}


SCORED = "row_id int, true_label string, predicted_label string, probability double"


def test_metrics_with_nothing_to_divide_by(spark):
    df = spark.createDataFrame([(1, "BENIGN", "BENIGN", 0.1), (2, "BENIGN", "BENIGN", 0.2)], SCORED)
    row = E.binary_metrics(df).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_subset_precision_is_one_when_anything_is_hit(spark):
    df = spark.createDataFrame([(1, "A", "A", 0.5), (2, "A", "B", 0.5), (3, "A", "B", 0.5), (4, "C", "A", 0.5)], SCORED)
    got = {r["attack_type"]: r for r in E.isolated_subset_eval(df).collect()}
    assert (got["A"]["precision"], got["A"]["f1"], got["A"]["top_confusions"]) == (1.0, pytest.approx(0.5), "B×2")
    whole = {r["attack_type"]: r for r in E.isolated_class_eval(df).collect()}
    assert whole["A"]["precision"] == 0.5 and whole["C"]["top_confusions"] == "A×1"


def test_threshold_edges_hit_exactly(spark):
    df = spark.createDataFrame([(i, "DDoS", "DDoS", i / 100) for i in range(101)], SCORED)
    for row in E.threshold_sweep(df, 1, 50, 1).collect():
        t = row["threshold_pct"]
        assert row["tp"] == sum(1 for i in range(101) if i / 100 >= t / 100)


def test_auc_of_perfect_and_useless_scores(spark):
    perfect = spark.createDataFrame([(i, "DDoS" if i > 5 else "BENIGN", "", i / 10) for i in range(10)], SCORED)
    assert E.roc_auc(perfect).first()[0] == pytest.approx(1.0) and E.pr_auc(perfect).first()[0] == pytest.approx(1.0)
    useless = spark.createDataFrame([(i, "DDoS" if i % 2 else "BENIGN", "", 0.5) for i in range(10)], SCORED)
    assert E.roc_auc(useless).first()[0] == pytest.approx(0.5)


def test_text_severity_counts_ddos_twice(spark):
    lines = spark.createDataFrame([("CRITICAL DDoS from a",), ("high web",), ("potential scan",), ("quiet",)], "line string")
    assert tuple(R.alert_severity_from_text(lines).first()) == (1, 2, 1, 0)


def test_bad_poll_interval_means_three_seconds(spark):
    df = spark.createDataFrame([(at(27), 5), (at(30), 7), (at(31), 9)], "received_at timestamp, total_packets int")
    for poll in ("x", None, -1, 0, 3):
        got = R.poll_activity(df, "2024-01-01 00:00:30.7", poll).collect()
        assert [r["y"] for r in got[-2:]] == [5, 7] and len(got) == 50


def test_attack_counts_always_have_benign(spark):
    df = spark.createDataFrame([("DDoS",), (None,)], "attack_label string")
    assert {tuple(r) for r in R.attack_counts(df).collect()} == {("DDoS", 1), ("unknown", 1), ("benign", 0)}


def test_parity_sees_missing_columns(spark):
    a = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    b = spark.createDataFrame([(float("inf"),), (None,)], "x double")
    got = {r["split"]: tuple(r)[1:] for r in A.schema_parity({"a": a, "b": b}).collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 1, 1)}


def test_leaking_file_is_named(spark):
    df = spark.createDataFrame([("f", "train"), ("f", "test"), ("g", "test")], "source_file string, split string")
    assert [tuple(r) for r in J.split_leakage(df).collect()] == [("f", "test,train")]

def test_averages_do_not_depend_on_row_order(spark):
    from flowlark.operators.correlate import correlate_alerts
    from flowlark.sources.tables import view

    rows = view(spark, "/root/testdata/sf0.01", "predictions").repartition(16).persist()
    got = [sorted(map(tuple, correlate_alerts(rows.repartition(n)).select("src_ip", "time_bucket", "predicted_label", "avg_confidence").collect())) for n in (1, 3, 16)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 1000
    few = spark.createDataFrame([("a", 0.0005), ("a", 0.0), ("b", 0.001), ("b", 0.002), ("c", None)], "k string, confidence double")
    from flowlark.operators.correlate import mean_confidence

    assert {r.k: r.m for r in few.groupBy("k").agg(mean_confidence().alias("m")).collect()} == {"a": 0.0, "b": 0.002, "c": None}
