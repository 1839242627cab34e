"""Detectors. Defaults are the published settings; names as given there.

Forests and boosted models are grown by `trees` on bounded samples, but for `gradient_boosting`, which takes all rows; the others
by MLlib or by one pass over the table's counts for each round.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from flowlark.functions import fixed
from flowlark.operators import evaluate as E
from flowlark.operators.clean import binary_label
from flowlark.operators.sampling import balanced_binary, class_weights, sample_per_class, specialist_training_set, with_balanced_weight
from flowlark.operators.scale import checked_small
from flowlark.operators.trees import TreeModel, binned_rows, cut_points, fit_boosted, fit_boosted_whole, fit_forest
from flowlark.session import cut_lineage

SEED = 42
#: First and last threshold, in percent, that a comparison tries, and the steps between.
STEPS = (5, 95, 5)


def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


def with_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", binary_label(F.col("label")))


def fit_binary(df: DataFrame, features: list[str], estimator, weighted: bool = False, scaled: bool = False) -> PipelineModel:
    """Pipeline from raw columns to a 0/1 prediction. Input needs `label`; BENIGN is 0."""
    rows = with_target(df)
    if weighted:
        rows = with_balanced_weight(rows, "target")
        estimator = estimator.setWeightCol("weight")
    stages = [assembler(features, "raw_features" if scaled else "features")]
    if scaled:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, estimator.setFeaturesCol("features").setLabelCol("target")]).fit(rows)


def with_class_number(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds `target`, the place of the label in the alphabetical list of labels, and gives that list (one entry per class)."""
    labels = sorted(r["label"] for r in rows.select("label").distinct().collect())
    number = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("label")) - 1
    return rows.withColumn("target", number.cast("int")), labels


def probabilities(scored: DataFrame) -> Column:
    """The class probabilities as an array, whichever kind of model gave them."""
    return F.col("probability") if isinstance(scored.schema["probability"].dataType, ArrayType) else vector_to_array("probability")


def attack_probability(scored: DataFrame) -> DataFrame:
    """Adds `probability` of attack and the label pair used by the evaluation operators."""
    p = probabilities(scored)[1]
    called = F.when(F.col("prediction") == 1, "ATTACK").otherwise("BENIGN")
    kept = [c for c in ("row_id", "label") if c in scored.columns]
    return scored.select(*kept, F.col("label").alias("true_label"), called.alias("predicted_label"), p.alias("probability"))


# Samples are bounded by their caps; each is written to the shared folder once, since fitting
# reads it many times.

# --- single models ------------------------------------------------------------------------


def rf_binary(df, features, trees: int = 100, depth: int | None = None, per_class: int = 50_000) -> TreeModel:
    sample = cut_lineage(with_balanced_weight(balanced_binary(df, per_class, per_class), "target"))
    return fit_forest(sample, features, "target", 2, "weight", trees, depth, seed=SEED)


def rf_multiclass(df, features, trees: int = 100, depth: int | None = None, cap: int = 20_000) -> TreeModel:
    sample, labels = with_class_number(cut_lineage(sample_per_class(df, cap)))
    model = fit_forest(sample, features, "target", len(labels), None, trees, depth, balance=True, seed=SEED)
    return replace(model, labels=labels)


def gbt_binary(df, features, rounds: int = 200, depth: int = 6, step: float = 0.1, per_class: int = 50_000) -> TreeModel:
    return fit_boosted(cut_lineage(balanced_binary(df, per_class, per_class)), features, "target", 2, None, rounds, depth, step, seed=SEED)


def gbt_multiclass(df, features, rounds: int = 200, depth: int = 6, step: float = 0.1, cap: int = 20_000) -> TreeModel:
    """Softmax over the classes; a class probability serves as confidence."""
    sample, labels = with_class_number(cut_lineage(sample_per_class(df, cap)))
    return replace(fit_boosted(sample, features, "target", max(len(labels), 3), None, rounds, depth, step, seed=SEED), labels=labels)


def gradient_boosting(df, features, rounds: int = 100, depth: int = 3) -> TreeModel:
    """The plain form of the comparison: all rows of the table and all features in each round."""
    return fit_boosted_whole(with_target(df), features, "target", rounds, depth)


def specialist_scope(named: list[str] | None = None, weak: list[str] | None = None) -> list[str]:
    """The classes a specialist is trained for: those named, else the weak ones an evaluation found, else the web family.

    An empty list of weak classes is an error: there is nothing to specialise in.
    """
    for choice in (named, weak, list(fixed.WEB_FAMILY)):
        if choice is not None:
            if not choice:
                raise ValueError("the list of classes is empty")
            return list(dict.fromkeys(choice))
    raise AssertionError


def specialist(df, features, classes: list[str], rounds: int = 300, depth: int = 6, step: float = 0.05) -> TreeModel:
    """Softmax over BENIGN and the specialist's classes, each row with the weight of its class."""
    sample = cut_lineage(specialist_training_set(df, classes))
    weights = class_weights(sample).select("label", F.col("specialist_weight").alias("weight"))
    rows, labels = with_class_number(sample.join(checked_small(weights), "label"))
    model = fit_boosted(rows, features, "target", max(len(labels), 3), "weight", rounds, depth, step, least=2.0, gamma=0.1, seed=SEED)
    return replace(model, labels=labels)


def logistic_regression(df, features) -> PipelineModel:
    return fit_binary(df, features, LogisticRegression(maxIter=100), weighted=True, scaled=True)


def decision_tree(df, features, depth: int = 20) -> PipelineModel:
    return fit_binary(df, features, DecisionTreeClassifier(maxDepth=depth, seed=SEED), weighted=True)


def mlp(df, features, hidden: tuple = (128, 64, 32), rounds: int = 100, per_class: int = 50_000, held: float = 0.1, every: int = 10, patience: int = 2) -> PipelineModel:
    """Layers 128-64-32 with sigmoid units; classes are balanced by sampling; stopped early.

    A share of the sample is held back. Every few rounds its log-loss is measured; once it has not fallen
    `patience` times in a row, or after `rounds`, the weights with the least loss are kept.
    """
    sample = cut_lineage(balanced_binary(df, per_class, per_class))
    aside = F.pmod(F.xxhash64("row_id"), F.lit(1000)) < int(held * 1000)
    scaler = Pipeline(stages=[assembler(features, "raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]).fit(sample)
    rows = cut_lineage(scaler.transform(sample).select("features", F.col("target").cast("double").alias("target"), aside.alias("aside")))
    fitted, judged = rows.where("NOT aside"), rows.where("aside")
    layers = [len(features), *hidden, 2]
    best, least, bad, weights = None, math.inf, 0, None
    for done in range(0, rounds, every):
        net = MultilayerPerceptronClassifier(layers=layers, maxIter=min(every, rounds - done), seed=SEED, blockSize=128, labelCol="target")
        model = (net if weights is None else net.setInitialWeights(weights)).fit(fitted)
        weights = model.weights
        loss = log_loss(model.transform(judged))
        if best is None or loss < least - 1e-6:
            best, least, bad = model, loss, 0
        else:
            bad += 1
            if bad >= patience:
                break
    return PipelineModel(stages=[*scaler.stages, best])


def log_loss(scored: DataFrame, target: str = "target") -> float:
    """Mean logarithmic loss of the probability of class 1; 0 for no rows."""
    p = F.least(F.greatest(probabilities(scored)[1], F.lit(1e-15)), F.lit(1 - 1e-15))
    return scored.agg(F.avg(-F.log(F.when(F.col(target) == 1, p).otherwise(1 - p))).alias("l")).first()["l"] or 0.0


@dataclass
class Stump:
    """Rows with a value up to `cut` (`low`) and the others (`high`) are called 1 or 0."""

    feature: str
    cut: float
    low: int
    high: int
    error: float
    vote: float


def stump_call(stump: Stump) -> Column:
    return F.when(F.col(stump.feature) <= stump.cut, stump.low).otherwise(stump.high)


def adaboost(df: DataFrame, features: list[str], rounds: int = 50, bins: int = 255) -> list[Stump]:
    """Weighted stumps: each round takes the best of all features and cuts from one aggregate of the weights
    per (feature, bin, class). Rows of equal bins and class have the same weight in every round, so the table is counted
    by them once and the rounds pass over the counts. A row's weight follows from the stumps so far.

    Cuts are quantiles of each feature; a null counts as beyond all cuts. Ties go to the first feature and cut.
    """
    cuts = cut_points(df, features, bins)
    made, names = binned_rows(with_target(df), features, cuts, "target")
    rows = cut_lineage(made.groupBy("target", *names).agg(F.count(F.lit(1)).cast("double").alias("n")))
    stumps: list[Stump] = []
    chosen: list[tuple[int, int, int, int, float]] = []
    for _ in range(rounds):

        def sums(batches, chosen=tuple(chosen)) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(names), 256, 2))
            for batch in batches:
                t = batch.column(0).to_numpy(zero_copy_only=False)
                made = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(names))]
                grown = np.zeros(len(t))
                for f, b, low, high, vote in chosen:
                    grown += vote * (np.where(made[f] <= b, low, high) != t)
                weight = np.exp(grown) * batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
                for f, m in enumerate(made):
                    total[f] += np.bincount(m * 2 + t, weight, 512).reshape(256, 2)
            f, b = np.nonzero(total.sum(axis=2))
            yield pa.RecordBatch.from_pydict({"f": pa.array(f, pa.int32()), "b": pa.array(b, pa.int32()), "w0": total[f, b, 0], "w1": total[f, b, 1]})

        # At most 256 rows for each feature come to the driver.
        found = rows.mapInArrow(sums, "f int, b int, w0 double, w1 double").groupBy("f", "b").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1")).collect()
        held = np.zeros((len(names), 256, 2))
        for r in found:
            held[r.f, r.b] = r.w0, r.w1
        total = held[0].sum()
        if not total:
            break
        left = held.cumsum(axis=1)
        right = left[:, -1:] - left
        error = (left.min(axis=2) + right.min(axis=2)) / total
        for f, c in enumerate(cuts):
            error[f, len(c) :] = np.inf
        f, b = np.unravel_index(int(np.round(error, 12).argmin()), error.shape)
        e = float(error[f, b])
        if e >= 0.5:
            break
        vote = math.log((1 - e) / max(e, 1e-12))
        low, high = int(left[f, b].argmax()), int(right[f, b].argmax())
        stumps.append(Stump(features[f], float(cuts[f][b]), low, high, e, vote))
        chosen.append((int(f), int(b), low, high, vote))
        if e == 0:
            break
    return stumps


def adaboost_score(df: DataFrame, stumps: list[Stump]) -> DataFrame:
    """Adds `predicted_label` and `probability` from the weighted vote."""
    total = sum(s.vote for s in stumps) or 1.0
    share = sum((s.vote * stump_call(s) for s in stumps), F.lit(0.0)) / total
    scored = df.withColumn("probability", share)
    return scored.withColumns({"true_label": F.col("label"), "predicted_label": F.when(F.col("probability") > 0.5, "ATTACK").otherwise("BENIGN")})


# --- using models --------------------------------------------------------------------------


def feature_importance(spark: SparkSession, model: TreeModel, n: int = 20) -> DataFrame:
    """The n features with the highest importance."""
    rows = list(zip(model.features, map(float, model.importance)))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(n)


def model_comparison(scored: dict[str, DataFrame], with_best_threshold: bool = False, times: str | None = None) -> DataFrame:
    """One row of metrics per model, best F1 first; optionally at each model's best threshold.

    times: a column that tells how many rows one stands for, as `evaluate.tallied` gives it."""
    parts = []
    for name, rows in scored.items():
        if with_best_threshold:
            sweep = E.threshold_sweep(rows, *STEPS, times=times)
            best = sweep.agg(F.max_by(F.struct(*sweep.columns), F.struct("f1", -F.col("threshold_pct"))).alias("b")).select("b.*")
            parts.append(best.select(F.lit(name).alias("model"), "threshold_pct", "accuracy", "precision", "recall", "f1"))
        else:
            parts.append(E.binary_metrics(rows, times).select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(F.col("f1").desc(), "model")


def save_model(model: PipelineModel | TreeModel, folder: str, about: dict) -> None:
    """Model and a line of JSON about it (label maps, class list) side by side."""
    spark = SparkSession.active()
    if isinstance(model, TreeModel):
        model.save(f"{folder}/model", spark)
    else:
        model.write().overwrite().save(f"{folder}/model")
    told = json.dumps({**about, "trees": isinstance(model, TreeModel)})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def load_model(spark: SparkSession, folder: str) -> tuple[PipelineModel | TreeModel, dict]:
    about = json.loads(spark.read.text(f"{folder}/about").first()["value"])
    trees = about.pop("trees")
    return (TreeModel.load(spark, f"{folder}/model") if trees else PipelineModel.load(f"{folder}/model")), about


def label_maps(model: TreeModel) -> dict:
    """Label to id, alphabetical, of a class model."""
    return {label: i for i, label in enumerate(model.labels)}


def confidence(scored: DataFrame) -> Column:
    """Greatest class probability to 4 places; 1 for a model without any."""
    return F.round(F.array_max(probabilities(scored)), 4) if "probability" in scored.columns else F.lit(1.0)


def score_models(df: DataFrame, binary: PipelineModel | TreeModel, classes: TreeModel, forest) -> DataFrame:
    """Model outputs beside the given columns: predictions, confidences to 4 places, anomaly score."""
    names, spark = df.columns, df.sparkSession
    trees = {"__binary": binary.shares(spark)} if isinstance(binary, TreeModel) else {}
    # All models are asked in one projection, so that the features go to Python once.
    asked = df.withColumns({**trees, "__classes": classes.shares(spark), "normality": forest.normal(spark)})
    first = binary.called(asked.withColumn("probability", F.col("__binary"))) if trees else binary.transform(asked)
    first = first.select(*names, "__classes", "normality", F.col("prediction").cast("int").alias("binary_prediction"), confidence(first).alias("binary_confidence"))
    second = classes.called(first.withColumn("probability", F.col("__classes")))
    kept = [*names, "binary_prediction", "binary_confidence"]
    second = second.select(*kept, F.col("predicted_label").alias("multiclass_label"), confidence(second).alias("multiclass_confidence"), "normality")
    return forest.flagged(second, [c for c in second.columns if c != "normality"]).withColumn("anomaly_score", F.round("anomaly_score", 4))
