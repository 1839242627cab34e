"""Detector evaluation. Every per-class measure starts from one count per (true, predicted)
pair, and every threshold measure from one count per threshold step, so the wide rows are
read once and nothing is multiplied by classes or thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.functions.expr import is_attack, ratio
from flowlark.operators.rules import routing_classes
from flowlark.operators.scale import running_totals

WEAK_BELOW = 0.70


def pair_counts(df: DataFrame, true: str = "true_label", predicted: str = "predicted_label", times: str | None = None) -> DataFrame:
    """Rows of each pair of labels; times: a column that tells how many rows one stands for."""
    n = F.sum(times) if times else F.count(F.lit(1))
    return df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(n.alias("n"))


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def binary_metrics(df: DataFrame, times: str | None = None) -> DataFrame:
    bad, called = is_attack(F.col("t")), is_attack(F.col("p"))
    sums = pair_counts(df, times=times).agg(
        _total(bad & called).alias("tp"), _total(~bad & called).alias("fp"), _total(bad & ~called).alias("fn"), _total(~bad & ~called).alias("tn")
    )
    return with_rates(sums)


def with_rates(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 beside tp, fp, fn and tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = df.select(
        "*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall")
    )
    return rates.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Counts of every pair of labels that occur, zeros kept."""
    counts = pair_counts(df)
    labels = counts.agg(F.sort_array(F.array_union(F.collect_set("t"), F.collect_set("p"))).alias("labels"))
    grid = labels.select(F.explode("labels").alias("t"), "labels").select("t", F.explode("labels").alias("p"))
    return grid.join(counts, ["t", "p"], "left").select(
        F.col("t").alias("true_label"), F.col("p").alias("predicted_label"), F.coalesce("n", F.lit(0)).alias("n_rows")
    ).orderBy("true_label", "predicted_label")


def fpr_adr(df: DataFrame) -> DataFrame:
    """Benign rows flagged and attack rows detected, in percent."""
    bad, called = is_attack(F.col("t")), is_attack(F.col("p"))
    return pair_counts(df).agg(
        (ratio(_total(~bad & called), _total(~bad)) * 100).alias("false_positive_rate"),
        (ratio(_total(bad & called), _total(bad)) * 100).alias("attack_detection_rate"),
    )


def class_metrics(df: DataFrame, predicted: str = "predicted_label") -> DataFrame:
    """label, support, correct, n_predicted, precision, recall, f1 for all labels that occur."""
    counts = pair_counts(df, predicted=predicted)
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.col("n").alias("support"), hit.alias("correct"), F.lit(0).cast("bigint").alias("n_predicted")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.lit(0).cast("bigint").alias("correct"), F.col("n").alias("n_predicted")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "correct", "n_predicted")])
    rates = sums.select("*", ratio(F.col("correct"), F.col("n_predicted")).alias("precision"), ratio(F.col("correct"), F.col("support")).alias("recall"))
    return rates.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def _averages(classes: DataFrame) -> DataFrame:
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), n)

    three = ("precision", "recall", "f1")
    return classes.agg(
        n.alias("support"), ratio(F.sum("correct"), n).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in three], *[weighted(c).alias(f"weighted_{c}") for c in three],
    )


def classification_report(df: DataFrame, predicted: str = "predicted_label") -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg."""
    classes = class_metrics(df, predicted)
    tails = [
        F.struct(F.lit(name).alias("label"), *[v.alias(k) for k, v in zip(("precision", "recall", "f1"), vals)], F.col("support").alias("support"))
        for name, vals in (
            ("accuracy", [F.col("accuracy")] * 3),
            ("macro avg", [F.col(f"macro_{c}") for c in ("precision", "recall", "f1")]),
            ("weighted avg", [F.col(f"weighted_{c}") for c in ("precision", "recall", "f1")]),
        )
    ]
    summary = _averages(classes).select(F.explode(F.array(*tails)).alias("s")).select("s.*")
    return classes.select("label", "precision", "recall", "f1", "support").unionByName(summary)


def weighted_metrics(df: DataFrame, predicted: str = "predicted_label") -> DataFrame:
    return _averages(class_metrics(df, predicted)).select("accuracy", "weighted_precision", "weighted_recall", "weighted_f1")


def _top_wrong(df: DataFrame, k: int, predicted: str = "predicted_label") -> DataFrame:
    """Per true label the k labels it is most often taken for, as text. Works on pair counts."""
    wrong = pair_counts(df, predicted=predicted).filter(F.col("t") != F.col("p"))
    order = Window.partitionBy("t").orderBy(F.col("n").desc(), "p")
    best = wrong.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    listed = F.array_sort(F.collect_list(F.struct("r", F.concat(F.col("p"), F.lit("×"), F.col("n").cast("string")).alias("text"))))
    return best.groupBy(F.col("t").alias("label")).agg(F.array_join(F.transform(listed, lambda s: s["text"]), ", ").alias("top_confusions"))


def isolated_class_eval(df: DataFrame) -> DataFrame:
    """Each true class: precision over the whole prediction set, detection rate, F1, top 3 confusions."""
    classes = class_metrics(df).filter(F.col("support") > 0)
    return classes.join(_top_wrong(df, 3), "label", "left").select(
        F.col("label").alias("attack_type"), "support", "correct", (F.col("recall") * 100).alias("detection_rate"), "precision",
        F.col("f1").alias("f1_score"), F.coalesce("top_confusions", F.lit("—")).alias("top_confusions"),
    )


def isolated_subset_eval(df: DataFrame, predicted: str = "predicted_label", with_benign: bool = False) -> DataFrame:
    """Each true class measured on its own rows only: precision is 1 as soon as one is hit."""
    classes = class_metrics(df, predicted).filter(F.col("support") > 0)
    if not with_benign:
        classes = classes.filter(F.col("label") != "BENIGN")
    precision = F.when(F.col("correct") > 0, 1.0).otherwise(0.0)
    return classes.join(_top_wrong(df, 5, predicted), "label", "left").select(
        F.col("label").alias("attack_type"), "support", "correct", precision.alias("precision"), "recall",
        f1_of(precision, F.col("recall")).alias("f1"), F.coalesce("top_confusions", F.lit("")).alias("top_confusions"),
    )


def weak_strong_classes(df: DataFrame, below: float = WEAK_BELOW) -> DataFrame:
    classes = class_metrics(df).filter(F.col("support") > 0)
    return classes.select(
        F.col("label").alias("attack_type"), "precision", "recall", F.col("f1").alias("f1_score"), "support",
        F.when(F.col("f1") < below, "WEAK").otherwise("STRONG").alias("status"),
    ).orderBy("f1_score", "attack_type")


def weak_strong_summary(report: DataFrame) -> DataFrame:
    weak = F.col("status") == "WEAK"
    return report.agg(
        F.count(F.lit(1)).alias("classes"), F.count(F.when(weak, 1)).alias("weak"), F.count(F.when(~weak, 1)).alias("strong"),
        F.avg("f1_score").alias("mean_f1"), F.array_join(F.sort_array(F.collect_list(F.when(weak, F.col("attack_type")))), ",").alias("weak_classes"),
    )


def specialist_comparison(df: DataFrame, classes: list[str], general: str = "general_label", specialist: str = "specialist_label") -> DataFrame:
    """General against specialist model on the rows of each specialist class and BENIGN."""
    names = sorted(set(classes) | {"BENIGN"})

    def side(column: str, prefix: str) -> DataFrame:
        rows = isolated_subset_eval(df, column, with_benign=True).filter(F.col("attack_type").isin(*names))
        return rows.select("attack_type", *(["support"] if prefix == "specialist" else []), *[F.col(c).alias(f"{prefix}_{c}") for c in ("precision", "recall", "f1")])

    both = side(specialist, "specialist").join(side(general, "general"), "attack_type")
    return both.withColumn("f1_improvement", F.col("specialist_f1") - F.col("general_f1")).orderBy("attack_type")


def specialist_gain(report: DataFrame) -> DataFrame:
    return report.filter(F.col("attack_type") != "BENIGN").agg(F.avg("f1_improvement").alias("mean_improvement"))


def ensemble_report(df: DataFrame, specialist: list[str] = (), general: str = "general_label", final: str = "final_label") -> DataFrame:
    """Per true class the F1 of the general model and of the ensemble."""
    g = class_metrics(df, general).select("label", "support", F.col("f1").alias("general_f1"))
    e = class_metrics(df, final).select("label", F.col("f1").alias("ensemble_f1"))
    rows = g.filter(F.col("support") > 0).join(e, "label", "left")
    after = F.coalesce("ensemble_f1", F.lit(0.0))
    return rows.select(
        F.col("label").alias("attack_type"), "support", "general_f1", after.alias("ensemble_f1"), (after - F.col("general_f1")).alias("f1_delta"),
        F.col("label").isin(*routing_classes(list(specialist))).cast("int").alias("routed_to_spec"),
    ).orderBy("attack_type")


def ensemble_deltas(report: DataFrame, specialist: list[str] = ()) -> DataFrame:
    """Mean F1 change over routed classes, specialist classes, and all attack classes."""
    chosen = F.col("attack_type").isin(*specialist) if specialist else F.lit(False)
    return report.agg(
        F.avg(F.when(F.col("routed_to_spec") == 1, F.col("f1_delta"))).alias("mean_delta_routed"),
        F.avg(F.when(chosen, F.col("f1_delta"))).alias("mean_delta_specialist"),
        F.avg("f1_delta").alias("mean_delta_all"),
    )


def routing_stats(df: DataFrame) -> DataFrame:
    """How many rows each trigger routed and how many of them were right before and after."""
    r, a, b = (F.col(c) == 1 for c in ("routed", "label_trigger", "confidence_trigger"))
    before, after = F.col("general_label") == F.col("true_label"), F.col("final_label") == F.col("true_label")
    counted = df.agg(
        F.count(F.lit(1)).alias("n_total"), F.count(F.when(r, 1)).alias("n_routed"), F.count(F.when(a, 1)).alias("n_label"),
        F.count(F.when(b, 1)).alias("n_confidence"), F.count(F.when(a & b, 1)).alias("n_both"),
        F.count(F.when(r & before, 1)).alias("correct_before"), F.count(F.when(r & after, 1)).alias("correct_after"),
    )
    return counted.withColumn("net_gain", F.col("correct_after") - F.col("correct_before"))


def routed_labels(df: DataFrame) -> DataFrame:
    """True labels among routed rows; true and general labels among rows routed by confidence alone."""
    only = (F.col("confidence_trigger") == 1) & (F.col("label_trigger") == 0)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("routed") == 1, F.struct(F.lit("routed_true").alias("kind"), F.col("true_label").alias("label"))),
            F.when(only, F.struct(F.lit("confidence_only_true").alias("kind"), F.col("true_label").alias("label"))),
            F.when(only, F.struct(F.lit("confidence_only_general").alias("kind"), F.col("general_label").alias("label"))),
        )
    )
    small = df.groupBy("routed", "label_trigger", "confidence_trigger", "true_label", "general_label").agg(F.count(F.lit(1)).alias("n"))
    return small.select(F.explode(kinds).alias("k"), "n").groupBy("k.kind", "k.label").agg(F.sum("n").alias("n_rows"))


def anomaly_detection_rate(df: DataFrame, flag: str = "predicted_anomaly") -> DataFrame:
    """Rows, flagged rows and rate in percent per true label."""
    return df.groupBy("true_label").agg(F.count(F.lit(1)).alias("total"), F.sum(flag).cast("bigint").alias("flagged")).withColumn(
        "detection_rate", ratio(F.col("flagged"), F.col("total")) * 100
    )


def anomaly_overall(rates: DataFrame, low: float = 10, high: float = 20) -> DataFrame:
    """False positive rate with its band, attack detection rate, and overall rate, from per-label rates."""
    benign = F.col("true_label") == "BENIGN"

    def part(condition: Column, c: str) -> Column:
        return F.sum(F.when(condition, F.col(c)))

    out = rates.agg(
        F.sum("total").alias("n_rows"), F.sum("flagged").alias("n_flagged"),
        (ratio(part(benign, "flagged"), part(benign, "total")) * 100).alias("false_positive_rate"),
        (ratio(part(~benign, "flagged"), part(~benign, "total")) * 100).alias("attack_detection_rate"),
        (ratio(F.sum("flagged"), F.sum("total")) * 100).alias("overall_rate"),
    )
    fpr = F.col("false_positive_rate")
    return out.withColumn("band", F.when(fpr < low, "low").when(fpr < high, "moderate").otherwise("high"))


def detection_by_attack(df: DataFrame, flag: str = "predicted_attack") -> DataFrame:
    return anomaly_detection_rate(df.filter(is_attack(F.col("true_label"))), flag)


def two_stage_by_attack(df: DataFrame, predicted: str = "final_label") -> DataFrame:
    """Per attack class: rows detected as any attack, rows given the right class."""
    counts = pair_counts(df, predicted=predicted).filter(is_attack(F.col("t")))
    sums = counts.groupBy(F.col("t").alias("true_label")).agg(
        F.sum("n").alias("total_attacks"), _total(is_attack(F.col("p"))).alias("detected"), _total(F.col("p") == F.col("t")).alias("classified")
    )
    return sums.select(
        "*", (ratio(F.col("detected"), F.col("total_attacks")) * 100).alias("detection_rate"),
        (ratio(F.col("classified"), F.col("total_attacks")) * 100).alias("classification_rate"),
    )


def two_stage_summary(df: DataFrame, predicted: str = "final_label") -> DataFrame:
    bad, called = is_attack(F.col("t")), is_attack(F.col("p"))
    out = pair_counts(df, predicted=predicted).agg(
        F.sum("n").alias("n_rows"), _total(bad).alias("attack_rows"), _total(~bad).alias("benign_rows"), _total(bad & ~called).alias("missed_attacks"),
        _total(~bad & called).alias("false_positives"),
        (ratio(_total(bad & called), _total(bad)) * 100).alias("detection_rate"), (ratio(_total(~bad & called), _total(~bad)) * 100).alias("fp_rate"),
    )
    rate = F.col("fp_rate")
    return out.withColumn("fp_band", F.when(rate < 1, "very low").when(rate < 5, "acceptable").when(rate < 10, "moderate").otherwise("high"))


def step_reached(p: Column, low: int, high: int, step: int) -> Column:
    """The number of the highest threshold low%, low+step%, ... up to high% that is at most p; -1 below all."""

    def threshold(i: Column) -> Column:
        return (F.lit(low) + i * F.lit(step)) / F.lit(100.0)

    guess = F.floor((p * 100 - low) / step).cast("int")
    at = F.when(threshold(guess + 1) <= p, guess + 1).when(threshold(guess) > p, guess - 1).otherwise(guess)
    return F.greatest(F.lit(-1), F.least(at, F.lit((high - low) // step)))


def tallied(df: DataFrame, low: int = 1, high: int = 50, step: int = 1, probability: str | None = "probability") -> DataFrame:
    """The rows counted (n_rows) by all that `binary_metrics` and a `threshold_sweep` of these steps see of them: both labels and
    the threshold reached, of which one probability stands for all. A few rows, however many are given."""
    alike, one = ["true_label", "predicted_label"], []
    if probability:
        p = F.col(probability)
        alike += [F.when(p.isNotNull(), step_reached(p, low, high, step)).alias("__step")]
        one = [F.min(probability).alias(probability)]
    return df.groupBy(*alike).agg(*one, F.count(F.lit(1)).alias("n_rows")).drop("__step")


def threshold_sweep(df: DataFrame, low: int = 1, high: int = 50, step: int = 1, probability: str = "probability", times: str | None = None) -> DataFrame:
    """Metrics of `probability >= t` for t = low%, low+step%, ... up to high%.

    Each row is counted once, or as often as the column `times` says, at the highest threshold it reaches; a running sum over the
    few steps gives all thresholds.
    """
    p, many = F.col(probability), F.col(times) if times else F.lit(1)
    n = (high - low) // step + 1
    bad = is_attack(F.col("true_label"))
    counts = df.filter(p.isNotNull()).groupBy(step_reached(p, low, high, step).alias("i")).agg(
        F.coalesce(F.sum(F.when(bad, many)), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(~bad, many)), F.lit(0)).alias("neg")
    )
    spine = df.sparkSession.range(-1, n, 1, 1).select(F.col("id").cast("int").alias("i"))
    filled = spine.join(counts, "i", "left").na.fill(0, ["pos", "neg"])
    from_top = Window.partitionBy(F.lit(0)).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    sums = filled.select(
        "i", F.sum("pos").over(from_top).alias("tp"), F.sum("neg").over(from_top).alias("fp"), F.sum("pos").over(whole).alias("all_pos"),
        F.sum("neg").over(whole).alias("all_neg"),
    ).filter(F.col("i") >= 0)
    parts = sums.select(
        (F.lit(low) + F.col("i") * step).alias("threshold_pct"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"),
        (F.col("all_neg") - F.col("fp")).alias("tn"),
    )
    return with_rates(parts).orderBy("threshold_pct")


def best_threshold(sweep: DataFrame, recall_goal: float = 0.70) -> DataFrame:
    """The threshold of the best F1 (lowest of equals) and the first one reaching the recall goal."""
    return sweep.agg(
        F.max_by("threshold_pct", F.struct("f1", -F.col("threshold_pct"))).alias("best_f1_pct"), F.max("f1").alias("best_f1"),
        F.min(F.when(F.col("recall") >= recall_goal, F.col("threshold_pct"))).alias("first_recall_pct"),
    )


def score_curve(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Per distinct score: positives and negatives at it and from the top down to it."""
    bad = is_attack(F.col("true_label"))
    points = df.filter(F.col(probability).isNotNull()).groupBy(F.col(probability).alias("score")).agg(
        F.count(F.when(bad, 1)).alias("pos"), F.count(F.when(~bad, 1)).alias("neg")
    )
    return running_totals(points, -F.col("score"), -F.col("score") * 65536, ["pos", "neg"])


def _with_sums(curve: DataFrame) -> DataFrame:
    return curve.crossJoin(curve.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")))  # one row


def pr_auc(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Area under precision over recall by trapezoids, starting at recall 0 and precision 1."""
    points = _with_sums(score_curve(df, probability))
    tp0, fp0 = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    now = ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    before = F.when(tp0 + fp0 == 0, 1.0).otherwise(ratio(tp0, tp0 + fp0))
    return points.agg(F.sum(ratio(F.col("pos"), F.col("all_pos")) * (now + before) / 2).alias("pr_auc"))


def roc_auc(df: DataFrame, probability: str = "probability") -> DataFrame:
    points = _with_sums(score_curve(df, probability))
    height = (2 * F.col("cum_pos") - F.col("pos")) / 2
    return points.agg(F.sum(ratio(F.col("neg"), F.col("all_neg")) * ratio(height, F.col("all_pos"))).alias("roc_auc"))


def roc_curve(df: DataFrame, probability: str = "probability") -> DataFrame:
    points = _with_sums(score_curve(df, probability))
    return points.select("score", ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"), ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"))
