"""Evaluation queries over the scored view."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.operators import evaluate as E
from flowlark.operators import rules as R
from flowlark.plans.registry import query
from flowlark.sources.tables import view, with_views

SCORED = with_views("scored")
FAMILY = "('Infiltration', 'WebAttack_BruteForce', 'WebAttack_SQLInjection', 'WebAttack_XSS')"
ADJACENT = "('DoS slowloris', 'DoS GoldenEye', 'DoS Hulk', 'DoS Slowhttptest', 'BENIGN', 'FTP-Patator')"
ROUTED = (
    SCORED
    + f""", g as (select row_id, true_label, predicted_label as general_label, probability as general_confidence,
  case when probability >= 0.3 then true_label else 'BENIGN' end as specialist_label from scored),
ro as (select *, cast(general_label in {FAMILY} as int) as label_trigger, cast(general_label in {ADJACENT} and general_confidence < 0.8 as int) as confidence_trigger from g),
ra as (select *, greatest(label_trigger, confidence_trigger) as routed,
  case when label_trigger + confidence_trigger > 0 then specialist_label else general_label end as final_label from ro)
"""
)


def classes(source: str, predicted: str, name: str) -> str:
    return f"""{name}_l as (select true_label as label from {source} union select {predicted} from {source}),
{name}_c as (select label, (select count(*) from {source} where true_label = label) as support,
  (select count(*) from {source} where true_label = label and {predicted} = label) as correct,
  (select count(*) from {source} where {predicted} = label) as n_predicted from {name}_l),
{name}_r as (select *, case when n_predicted = 0 then 0 else correct / n_predicted::double end as precision,
  case when support = 0 then 0 else correct / support::double end as recall from {name}_c),
{name} as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from {name}_r)"""


def rounded(df, *columns, places=4):
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


def scored(spark, sf):
    return view(spark, sf, "scored")


def routed(spark, sf):
    rows = scored(spark, sf).select(
        "row_id", "true_label", F.col("predicted_label").alias("general_label"), F.col("probability").alias("general_confidence"),
        F.when(F.col("probability") >= 0.3, F.col("true_label")).otherwise("BENIGN").alias("specialist_label"),
    )
    return R.ensemble_route(rows, specialist=fixed.WEB_FAMILY)


CONFUSION4 = """count(*) filter (true_label <> 'BENIGN' and {p}) as tp, count(*) filter (true_label = 'BENIGN' and {p}) as fp,
  count(*) filter (true_label <> 'BENIGN' and not ({p})) as fn, count(*) filter (true_label = 'BENIGN' and not ({p})) as tn"""
RATES = """round((tp + tn) / (tp + fp + fn + tn)::double, 6) as accuracy, round(case when tp + fp = 0 then 0 else tp / (tp + fp)::double end, 6) as precision,
  round(case when tp + fn = 0 then 0 else tp / (tp + fn)::double end, 6) as recall, round(case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn)::double end, 6) as f1"""


@query("binary_metrics", SCORED + ", m as (select " + CONFUSION4.format(p="predicted_label <> 'BENIGN'") + f" from scored) select *, {RATES} from m")
def binary_metrics(spark, sf):
    return rounded(E.binary_metrics(scored(spark, sf)), "accuracy", "precision", "recall", "f1", places=6)


@query(
    "confusion_matrix",
    SCORED
    + """, l as (select true_label as x from scored union select predicted_label from scored)
select a.x as true_label, b.x as predicted_label, (select count(*) from scored where true_label = a.x and predicted_label = b.x) as n_rows from l a cross join l b""",
)
def confusion_matrix(spark, sf):
    return E.confusion_matrix(scored(spark, sf))


@query(
    "fpr_adr",
    SCORED
    + """ select round(avg((predicted_label <> 'BENIGN')::int) filter (true_label = 'BENIGN') * 100, 4) as false_positive_rate,
  round(avg((predicted_label <> 'BENIGN')::int) filter (true_label <> 'BENIGN') * 100, 4) as attack_detection_rate from scored""",
)
def fpr_adr(spark, sf):
    return rounded(E.fpr_adr(scored(spark, sf)), "false_positive_rate", "attack_detection_rate")


REPORT = (
    SCORED
    + ", "
    + classes("scored", "predicted_label", "c")
    + ", n as (select count(*) as n, avg((true_label = predicted_label)::int) as acc from scored)"
)


@query(
    "classification_report",
    REPORT
    + """ select label, round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1, support from c
union all select 'accuracy', round(acc, 4), round(acc, 4), round(acc, 4), n from n
union all select 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), cast(sum(support) as bigint) from c
union all select 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), cast(sum(support) as bigint) from c""",
)
def classification_report(spark, sf):
    return rounded(E.classification_report(scored(spark, sf)), "precision", "recall", "f1")


@query(
    "weighted_metrics",
    REPORT
    + """ select (select round(acc, 4) from n) as accuracy, round(sum(precision * support) / sum(support), 4) as weighted_precision,
  round(sum(recall * support) / sum(support), 4) as weighted_recall, round(sum(f1 * support) / sum(support), 4) as weighted_f1 from c""",
)
def weighted_metrics(spark, sf):
    out = E.weighted_metrics(scored(spark, sf))
    return rounded(out, *out.columns)


WRONG = """, w as (select true_label as label, predicted_label as p, count(*) as n, row_number() over (partition by true_label order by count(*) desc, predicted_label) as r
  from {0} where true_label <> {1} group by 1, 2), t as (select label, string_agg(p || '×' || n, ', ' order by r) as top from w where r <= {2} group by 1)"""


@query(
    "isolated_class_eval",
    REPORT
    + WRONG.format("scored", "predicted_label", 3)
    + """ select label as attack_type, support, correct, round(recall * 100, 4) as detection_rate, round(precision, 4) as precision,
  round(f1, 4) as f1_score, coalesce(top, '—') as top_confusions from c left join t using (label) where support > 0""",
)
def isolated_class_eval(spark, sf):
    return rounded(E.isolated_class_eval(scored(spark, sf)), "detection_rate", "precision", "f1_score")


@query(
    "isolated_subset_eval",
    REPORT
    + WRONG.format("scored", "predicted_label", 5)
    + """ select label as attack_type, support, correct, case when correct > 0 then 1.0::double else 0 end as precision, round(recall, 4) as recall,
  round(case when correct = 0 then 0 else 2 * recall / (1 + recall) end, 4) as f1, coalesce(top, '') as top_confusions
from c left join t using (label) where support > 0 and label <> 'BENIGN'""",
)
def isolated_subset_eval(spark, sf):
    return rounded(E.isolated_subset_eval(scored(spark, sf)), "recall", "f1")


@query(
    "weak_strong_classes",
    REPORT
    + """ select label as attack_type, round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1_score, support,
  case when f1 < 0.8 then 'WEAK' else 'STRONG' end as status from c where support > 0""",
)
def weak_strong_classes(spark, sf):
    return rounded(E.weak_strong_classes(scored(spark, sf), 0.8), "precision", "recall", "f1_score")


@query(
    "weak_strong_summary",
    REPORT
    + """ select count(*) as classes, count(*) filter (f1 < 0.8) as weak, count(*) filter (f1 >= 0.8) as strong, round(avg(f1), 4) as mean_f1,
  coalesce(string_agg(label, ',' order by label) filter (f1 < 0.8), '') as weak_classes from c where support > 0""",
)
def weak_strong_summary(spark, sf):
    return rounded(E.weak_strong_summary(E.weak_strong_classes(scored(spark, sf), 0.8)), "mean_f1")


@query(
    "ensemble_route",
    ROUTED + " select row_id, label_trigger, confidence_trigger, routed, final_label from ra",
)
def ensemble_route(spark, sf):
    return routed(spark, sf).select("row_id", "label_trigger", "confidence_trigger", "routed", "final_label")


@query(
    "two_stage_cascade",
    SCORED + " select row_id, true_label, case when probability >= 0.35 then predicted_label else 'BENIGN' end as final_label from scored",
)
def two_stage_cascade(spark, sf):
    out = R.two_stage_cascade(scored(spark, sf), 0.35, second="predicted_label")
    return out.select("row_id", "true_label", "final_label")


@query(
    "specialist_comparison",
    ROUTED
    + f""", s as (select true_label as attack_type, count(*) as support, avg((specialist_label = true_label)::int) as sr, avg((general_label = true_label)::int) as gr
  from ra where true_label in {FAMILY} or true_label = 'BENIGN' group by 1)
select attack_type, support, case when sr > 0 then 1.0::double else 0 end as specialist_precision, round(sr, 4) as specialist_recall, round(2 * sr / (1 + sr), 4) as specialist_f1,
  case when gr > 0 then 1.0::double else 0 end as general_precision, round(gr, 4) as general_recall, round(2 * gr / (1 + gr), 4) as general_f1,
  round(2 * sr / (1 + sr) - 2 * gr / (1 + gr), 4) + 0.0 as f1_improvement from s""",
)
def specialist_comparison(spark, sf):
    out = E.specialist_comparison(routed(spark, sf), fixed.WEB_FAMILY)
    return rounded(out, *[c for c in out.columns if c not in ("attack_type", "support")])


@query(
    "specialist_gain",
    ROUTED
    + f""", s as (select true_label, avg((specialist_label = true_label)::int) as sr, avg((general_label = true_label)::int) as gr
  from ra where true_label in {FAMILY} group by 1) select round(avg(2 * sr / (1 + sr) - 2 * gr / (1 + gr)), 4) as mean_improvement from s""",
)
def specialist_gain(spark, sf):
    return rounded(E.specialist_gain(E.specialist_comparison(routed(spark, sf), fixed.WEB_FAMILY)), "mean_improvement")


ENSEMBLE = (
    ROUTED
    + ", "
    + classes("ra", "general_label", "gc")
    + ", "
    + classes("ra", "final_label", "ec")
    + f""", er as (select gc.label as attack_type, gc.support, gc.f1 as general_f1, coalesce(ec.f1, 0) as ensemble_f1, coalesce(ec.f1, 0) - gc.f1 as f1_delta,
  cast(gc.label in {FAMILY} as int) as routed_to_spec from gc left join ec using (label) where gc.support > 0)"""
)


@query(
    "ensemble_report",
    ENSEMBLE
    + " select attack_type, support, round(general_f1, 4) as general_f1, round(ensemble_f1, 4) as ensemble_f1, round(f1_delta, 4) + 0.0 as f1_delta, routed_to_spec from er",
)
def ensemble_report(spark, sf):
    return rounded(E.ensemble_report(routed(spark, sf), fixed.WEB_FAMILY), "general_f1", "ensemble_f1", "f1_delta")


@query(
    "ensemble_deltas",
    ENSEMBLE
    + f""" select round(avg(f1_delta) filter (routed_to_spec = 1), 4) as mean_delta_routed, round(avg(f1_delta) filter (attack_type in {FAMILY}), 4) as mean_delta_specialist,
  round(avg(f1_delta), 4) as mean_delta_all from er""",
)
def ensemble_deltas(spark, sf):
    out = E.ensemble_deltas(E.ensemble_report(routed(spark, sf), fixed.WEB_FAMILY), fixed.WEB_FAMILY)
    return rounded(out, *out.columns)


@query(
    "routing_stats",
    ROUTED
    + """ select count(*) as n_total, count(*) filter (routed = 1) as n_routed, count(*) filter (label_trigger = 1) as n_label,
  count(*) filter (confidence_trigger = 1) as n_confidence, count(*) filter (label_trigger + confidence_trigger = 2) as n_both,
  count(*) filter (routed = 1 and general_label = true_label) as correct_before, count(*) filter (routed = 1 and final_label = true_label) as correct_after,
  count(*) filter (routed = 1 and final_label = true_label) - count(*) filter (routed = 1 and general_label = true_label) as net_gain from ra""",
)
def routing_stats(spark, sf):
    return E.routing_stats(routed(spark, sf))


@query(
    "routed_labels",
    ROUTED
    + """ select 'routed_true' as kind, true_label as label, count(*) as n_rows from ra where routed = 1 group by 2
union all select 'confidence_only_true', true_label, count(*) from ra where confidence_trigger = 1 and label_trigger = 0 group by 2
union all select 'confidence_only_general', general_label, count(*) from ra where confidence_trigger = 1 and label_trigger = 0 group by 2""",
)
def routed_labels(spark, sf):
    return E.routed_labels(routed(spark, sf))


ANOMALY = SCORED + ", an as (select *, cast(probability >= 0.8 as int) as f from scored)"


def anomalies(spark, sf):
    return scored(spark, sf).withColumn("predicted_anomaly", (F.col("probability") >= 0.8).cast("int"))


@query(
    "anomaly_detection_rate",
    ANOMALY + " select true_label, count(*) as total, cast(sum(f) as bigint) as flagged, round(avg(f) * 100, 4) as detection_rate from an group by 1",
)
def anomaly_detection_rate(spark, sf):
    return rounded(E.anomaly_detection_rate(anomalies(spark, sf)), "detection_rate")


@query(
    "anomaly_overall",
    ANOMALY
    + """ select count(*) as n_rows, cast(sum(f) as bigint) as n_flagged, round(avg(f) filter (true_label = 'BENIGN') * 100, 4) as false_positive_rate,
  round(avg(f) filter (true_label <> 'BENIGN') * 100, 4) as attack_detection_rate, round(avg(f) * 100, 4) as overall_rate,
  case when avg(f) filter (true_label = 'BENIGN') < 0.1 then 'low' when avg(f) filter (true_label = 'BENIGN') < 0.2 then 'moderate' else 'high' end as band from an""",
)
def anomaly_overall(spark, sf):
    out = E.anomaly_overall(E.anomaly_detection_rate(anomalies(spark, sf)))
    return rounded(out, "false_positive_rate", "attack_detection_rate", "overall_rate")


@query(
    "detection_by_attack",
    SCORED
    + """ select true_label, count(*) as total, count(*) filter (predicted_label <> 'BENIGN') as flagged,
  round(count(*) filter (predicted_label <> 'BENIGN') * 100.0::double / count(*), 4) as detection_rate from scored where true_label <> 'BENIGN' group by 1""",
)
def detection_by_attack(spark, sf):
    rows = scored(spark, sf).withColumn("predicted_attack", (F.col("predicted_label") != "BENIGN").cast("int"))
    return rounded(E.detection_by_attack(rows), "detection_rate")


STAGED = SCORED + ", st as (select true_label, case when probability >= 0.35 then predicted_label else 'BENIGN' end as p from scored)"


@query(
    "two_stage_by_attack",
    STAGED
    + """ select true_label, count(*) as total_attacks, count(*) filter (p <> 'BENIGN') as detected, count(*) filter (p = true_label) as classified,
  round(count(*) filter (p <> 'BENIGN') * 100.0::double / count(*), 4) as detection_rate, round(count(*) filter (p = true_label) * 100.0::double / count(*), 4) as classification_rate
from st where true_label <> 'BENIGN' group by 1""",
)
def two_stage_by_attack(spark, sf):
    out = E.two_stage_by_attack(R.two_stage_cascade(scored(spark, sf), 0.35, second="predicted_label"))
    return rounded(out, "detection_rate", "classification_rate")


@query(
    "two_stage_summary",
    STAGED
    + """, z as (select count(*) as n_rows, count(*) filter (true_label <> 'BENIGN') as attack_rows, count(*) filter (true_label = 'BENIGN') as benign_rows,
  count(*) filter (true_label <> 'BENIGN' and p = 'BENIGN') as missed_attacks, count(*) filter (true_label = 'BENIGN' and p <> 'BENIGN') as false_positives from st)
select *, round((attack_rows - missed_attacks) * 100.0::double / attack_rows, 4) as detection_rate, round(false_positives * 100.0::double / benign_rows, 4) as fp_rate,
  case when false_positives * 100 < benign_rows then 'very low' when false_positives * 20 < benign_rows then 'acceptable'
    when false_positives * 10 < benign_rows then 'moderate' else 'high' end as fp_band from z""",
)
def two_stage_summary(spark, sf):
    out = E.two_stage_summary(R.two_stage_cascade(scored(spark, sf), 0.35, second="predicted_label"))
    return rounded(out, "detection_rate", "fp_rate")


SWEEP = (
    SCORED
    + ", sw as (select cast(i as int) as threshold_pct, "
    + CONFUSION4.format(p="probability >= i / 100.0::double")
    + " from scored cross join range({0}, {1}, {2}) t(i) group by 1)"
)


@query("threshold_sweep", SWEEP.format(1, 51, 1) + f" select *, {RATES} from sw")
def threshold_sweep(spark, sf):
    return rounded(E.threshold_sweep(scored(spark, sf)), "accuracy", "precision", "recall", "f1", places=6)


@query("threshold_sweep_coarse", SWEEP.format(10, 95, 5) + f" select *, {RATES} from sw")
def threshold_sweep_coarse(spark, sf):
    return rounded(E.threshold_sweep(scored(spark, sf), 10, 94, 5), "accuracy", "precision", "recall", "f1", places=6)


@query(
    "best_threshold",
    SWEEP.format(5, 51, 1)
    + """, f as (select *, 2 * tp / (2 * tp + fp + fn)::double as f1, tp / (tp + fn)::double as recall from sw)
select (select threshold_pct from f order by f1 desc, threshold_pct limit 1) as best_f1_pct, round(max(f1), 4) as best_f1,
  min(threshold_pct) filter (recall >= 0.7) as first_recall_pct from f""",
)
def best_threshold(spark, sf):
    return rounded(E.best_threshold(E.threshold_sweep(scored(spark, sf), 5, 50, 1)), "best_f1")


CURVE = (
    SCORED
    + """, d as (select probability as s, count(*) filter (true_label <> 'BENIGN') as pos, count(*) filter (true_label = 'BENIGN') as neg from scored group by 1),
w as (select s, sum(pos) over (order by s desc) as tp, sum(neg) over (order by s desc) as fp, sum(pos) over () as ap, sum(neg) over () as an from d),
v as (select *, lag(tp, 1, 0) over (order by s desc) as tp0, lag(fp, 1, 0) over (order by s desc) as fp0 from w)
"""
)


@query(
    "pr_auc",
    CURVE
    + """ select round(sum((tp - tp0) / ap::double * (tp / (tp + fp)::double + case when tp0 + fp0 = 0 then 1 else tp0 / (tp0 + fp0)::double end) / 2), 4) as pr_auc from v""",
)
def pr_auc(spark, sf):
    return rounded(E.pr_auc(scored(spark, sf)), "pr_auc")


@query("roc_auc", CURVE + " select round(sum((fp - fp0) / an::double * (tp + tp0) / 2 / ap::double), 4) as roc_auc from v")
def roc_auc(spark, sf):
    return rounded(E.roc_auc(scored(spark, sf)), "roc_auc")


@query("roc_curve", CURVE + " select s as score, round(fp / an::double, 4) as fpr, round(tp / ap::double, 4) as tpr from v")
def roc_curve(spark, sf):
    return rounded(E.roc_curve(scored(spark, sf)), "fpr", "tpr")
