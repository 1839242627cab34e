"""Model queries. Training uses the table's training split, with the operators' defaults, which are the published settings.

What a model predicts is no matter for SQL. A query with SQL gives the totals of the evaluated rows, and
whether the model has learnt what a constant one cannot: a stated floor on the rows it was fitted on (labels of
the supplied tables do not follow from the features, so nothing can be asked of held-out rows). The
measures themselves come from the queries without SQL.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.operators import clean as P
from flowlark.operators import evaluate as E
from flowlark.operators import models as M
from flowlark.operators import neighbors as N
from flowlark.operators import rules as R
from flowlark.operators import sampling as B
from flowlark.operators import synthesis as Y
from flowlark.operators.isolation import fit_isolation_forest
from flowlark.plans.q_profile import FILES, LABELS, SPLIT, labelled
from flowlark.plans.registry import query
from flowlark.session import cut_lineage
from flowlark.streaming.run import fresh_folder

FEATURES = ["f_packets", "f_bytes", "f_rate"]


def parts(spark, sf):
    """Cleaned rows of the training split and of the rest."""
    rows = B.temporal_split(P.clean_numeric(labelled(spark, sf)), FILES)
    return rows.filter("split = 'train'").drop("split"), rows.filter("split <> 'train'").drop("split")


TEST = SPLIT + """, ok2 as (select * from sp where f_rate is not null and not isinf(f_rate)),
tr as (select * from ok2 where split = 'train'), te as (select * from ok2 where split <> 'train')
"""
BINARY = TEST + """ select count(*) filter (label <> 'BENIGN') as n_attack, count(*) filter (label = 'BENIGN') as n_benign, true as learnt from te"""
CLASSES = TEST + " select label, count(*) as support, true as learnt from te group by 1"
#: Least share of right calls, each class alike, of a forest or tree on the rows it was fitted on; a constant has a half.
FITTED_FOREST, FITTED_TREE = 0.9, 0.55
#: Least area under the curve of the others on their own rows; a constant has exactly a half.
FITTED_BOOSTED, FITTED_SMOOTH = 0.6, 0.5 + 1e-9
#: Least mean recall of the classes on the fitted rows, times their number; a constant has 1.
FITTED_CLASSES = 1.5


def fitted(train):
    """The balanced sample the binary models are fitted on."""
    return B.balanced_binary(train)


def accurate(scored, floor: float):
    """Whether the share of right calls, each class alike, reaches the floor; one row."""
    rates = E.binary_metrics(scored)
    shares = [F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)) for a, b in (("tp", "fn"), ("tn", "fp"))]
    return rates.select(((shares[0] + shares[1]) / 2 >= floor).alias("learnt"))


def ranked(scored, floor: float):
    """Whether the area under the curve reaches the floor; one row."""
    return E.roc_auc(M.attack_probability(scored)).select((F.col("roc_auc") >= floor).alias("learnt"))


def totals(scored):
    rates = E.binary_metrics(scored)
    return rates.select((F.col("tp") + F.col("fn")).alias("n_attack"), (F.col("fp") + F.col("tn")).alias("n_benign"))


def report(spark, sf, fit, check, sample=fitted):
    train, rest = parts(spark, sf)
    model = fit(train)
    known = check(model.transform(sample(train)))
    return totals(M.attack_probability(model.transform(rest))).crossJoin(known)  # one row each


def class_report(spark, sf, fit, sample):
    train, rest = parts(spark, sf)
    model = fit(train)
    scored = model.transform(rest).select(F.col("label").alias("true_label"), "predicted_label")
    own = model.transform(sample(train)).groupBy("label").agg(F.avg((F.col("label") == F.col("predicted_label")).cast("int")).alias("recall"))
    known = own.agg((F.sum("recall") >= FITTED_CLASSES).alias("learnt"))  # one row
    rows = E.classification_report(scored).filter(~F.col("label").isin("accuracy", "macro avg", "weighted avg") & (F.col("support") > 0))
    return rows.select("label", F.col("support").cast("bigint").alias("support")).crossJoin(known)


def inside(made, real):
    """Per class how many rows were made, and how many lie inside the range of its real rows."""
    bounds = real.groupBy("label").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in FEATURES for f in (F.min, F.max)])  # a row per class
    fits = reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"min_{c}") - 1e-6, F.col(f"max_{c}") + 1e-6) for c in FEATURES])
    return made.join(bounds, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(fits, 1)).alias("n_inside"))


@query("rf_binary", BINARY)
def rf_binary(spark, sf):
    return report(spark, sf, lambda rows: M.rf_binary(rows, FEATURES), lambda own: accurate(M.attack_probability(own), FITTED_FOREST))


@query("rf_multiclass", CLASSES)
def rf_multiclass(spark, sf):
    return class_report(spark, sf, lambda rows: M.rf_multiclass(rows, FEATURES), lambda rows: B.sample_per_class(rows, 20_000))


@query("gbt_binary", BINARY)
def gbt_binary(spark, sf):
    return report(spark, sf, lambda rows: M.gbt_binary(rows, FEATURES), lambda own: ranked(own, FITTED_BOOSTED))


@query("gbt_multiclass", CLASSES)
def gbt_multiclass(spark, sf):
    return class_report(spark, sf, lambda rows: M.gbt_multiclass(rows, FEATURES), lambda rows: B.sample_per_class(rows, 20_000))


@query("specialist", CLASSES)
def specialist(spark, sf):
    """Fitted on the training rows and the made ones of the weak classes."""
    scope = M.specialist_scope()
    return class_report(
        spark, sf, lambda rows: M.specialist(Y.augmented(rows, FEATURES), FEATURES, scope), lambda rows: B.specialist_training_set(rows, scope)
    )


@query("ensemble_models", TEST + " select count(*) as n_rows, 0::bigint as n_answered_unrouted, 0::bigint as n_unanswered, 0::bigint as n_changed_unrouted from te")
def ensemble_models(spark, sf):
    """A general model, and the specialist scored on the rows that are routed to it and on no others."""
    train, rest = parts(spark, sf)
    general, special = M.gbt_multiclass(train, FEATURES), M.specialist(train, FEATURES, M.specialist_scope())
    scored = general.transform(rest)
    flagged = scored.select("row_id", *FEATURES, F.col("predicted_label").alias("general_label"), M.confidence(scored).alias("general_confidence"))
    out = R.route_and_score(flagged, lambda rows: special.transform(rows).select("row_id", F.col("predicted_label").alias("specialist_label")))
    by_label, by_confidence = R.route_triggers(F.col("general_label"), F.col("general_confidence"))
    sent = by_label | by_confidence
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(~sent & F.col("specialist_label").isNotNull(), 1)).alias("n_answered_unrouted"),
        F.count(F.when(sent & F.col("specialist_label").isNull(), 1)).alias("n_unanswered"),
        F.count(F.when(~sent & (F.col("final_label") != F.col("general_label")), 1)).alias("n_changed_unrouted"),
    )


@query("logistic_regression", BINARY)
def logistic_regression(spark, sf):
    return report(spark, sf, lambda rows: M.logistic_regression(rows, FEATURES), lambda own: ranked(own, FITTED_SMOOTH), lambda rows: rows)


@query("decision_tree", BINARY)
def decision_tree(spark, sf):
    return report(spark, sf, lambda rows: M.decision_tree(rows, FEATURES), lambda own: accurate(M.attack_probability(own), FITTED_TREE), lambda rows: rows)


@query("mlp", BINARY)
def mlp(spark, sf):
    return report(spark, sf, lambda rows: M.mlp(rows, FEATURES), lambda own: ranked(own, FITTED_SMOOTH))


@query("adaboost", BINARY)
def adaboost(spark, sf):
    """Learnt: every stump is better than a guess on its weights, and the exponential loss falls with each."""
    train, rest = parts(spark, sf)
    stumps = M.adaboost(train, FEATURES)
    shrinks = [2 * math.sqrt(s.error * (1 - s.error)) for s in stumps]
    known = spark.range(1).select(F.lit(bool(stumps) and all(s.error < 0.5 for s in stumps) and math.prod(shrinks) < 1).alias("learnt"))
    return totals(M.adaboost_score(rest, stumps)).crossJoin(known)  # one row each


@query("feature_importance")
def feature_importance(spark, sf):
    train, _ = parts(spark, sf)
    return M.feature_importance(spark, M.rf_binary(train, FEATURES))


@query("model_comparison")
def model_comparison(spark, sf):
    """Six models by their measures on held-out rows, as they are and at their best thresholds."""
    train, rest = parts(spark, sf)
    own = cut_lineage(fitted(train))
    near = N.knn_classify(points(rest), points(own), 5).select("id", "predicted_label")
    by_id = rest.select(F.col("row_id").alias("id"), F.col("label").alias("true_label")).join(near, "id")
    scored = {
        "logistic_regression": M.attack_probability(M.logistic_regression(train, FEATURES).transform(rest)),
        "decision_tree": M.attack_probability(M.decision_tree(train, FEATURES).transform(rest)),
        "random_forest": M.attack_probability(M.rf_binary(train, FEATURES).transform(rest)),
        "gradient_boosting": M.attack_probability(M.gradient_boosting(train, FEATURES).transform(rest)),
        "adaboost": M.adaboost_score(rest, M.adaboost(train, FEATURES)).select("row_id", "label", "true_label", "predicted_label", "probability"),
    }
    # Each model scores once; only counts of its scored rows are written.
    scored = {name: cut_lineage(E.tallied(rows, *M.STEPS)) for name, rows in scored.items()}
    plain = M.model_comparison({**scored, "knn": E.tallied(by_id, probability=None)}, times="n_rows").withColumn("threshold_pct", F.lit(50))
    tuned = M.model_comparison(scored, with_best_threshold=True, times="n_rows").withColumn("model", F.concat("model", F.lit(" tuned")))
    return plain.unionByName(tuned)


def points(rows):
    """Rows as vectors, in units of each feature's spread over typical flows, with a binary label."""
    vector = F.array(F.col("f_packets").cast("double") / 15, F.col("f_bytes").cast("double") / 30_000, F.col("f_rate").cast("double") / 2_000_000)
    return rows.select(F.col("row_id").alias("id"), vector.alias("vector"), F.when(F.col("label") == "BENIGN", "BENIGN").otherwise("ATTACK").alias("label"))


@query("model_store", TEST + " select count(*) as n_rows, 0 as n_different, 6 as n_labels from te")
def model_store(spark, sf):
    """A stored and loaded model scores as before."""
    train, rest = parts(spark, sf)
    model = M.rf_multiclass(train, FEATURES)
    folder = fresh_folder(spark, "model")
    M.save_model(model, folder, {"label_to_id": M.label_maps(model), "classes": fixed.WEB_FAMILY})
    again, about = M.load_model(spark, folder)
    first, second = (m.transform(rest).select("row_id", F.col("probability").alias(n)) for m, n in ((model, "a"), (again, "b")))
    differ = F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1))
    both = first.join(second, "row_id").agg(F.count(F.lit(1)).alias("n_rows"), differ.alias("n_different"))
    return both.withColumn("n_labels", F.lit(len(about["label_to_id"])))


@query("isolation_forest", TEST + " select least(count(*), 150000) as n_fitted, true as share_kept from tr where label = 'BENIGN'")
def isolation_forest(spark, sf):
    """Of the rows it was fitted on, the forest flags the set share of 5 %."""
    train, _ = parts(spark, sf)
    own = B.benign_only(train)
    flagged = fit_isolation_forest(own, FEATURES).predict(own).agg(F.count(F.lit(1)).alias("n_fitted"), F.avg("anomaly_flag").alias("share"))
    return flagged.select("n_fitted", F.col("share").between(0.045, 0.055).alias("share_kept"))


@query("anomaly_rates")
def anomaly_rates(spark, sf):
    """Flagged rows of each label among 25,000 benign and 25,000 attack rows that were held out."""
    train, rest = parts(spark, sf)
    forest = fit_isolation_forest(B.benign_only(train), FEATURES)
    judged = B.balanced_binary(rest, 25_000, 25_000)
    scored = forest.predict(judged).select(F.col("label").alias("true_label"), F.col("anomaly_flag").alias("predicted_anomaly"))
    return E.anomaly_detection_rate(scored)


#: The most rows of a class any detector is fitted on: the cap of `benign_only`.
MOST_OF_A_CLASS = 150_000


def fitted_detectors(train):
    """Three detectors. Each samples the first rows of its classes in one and the same order, so the first rows of every label,
    as many as the greatest cap, hold all samples; they are written once and the table is not gone through for each sample."""
    pool = cut_lineage(B.sample_per_class(train, MOST_OF_A_CLASS))
    return M.rf_binary(pool, FEATURES), M.rf_multiclass(pool, FEATURES), fit_isolation_forest(B.benign_only(pool), FEATURES)


@query("score_models")
def score_models(spark, sf):
    train, rest = parts(spark, sf)
    return M.score_models(rest.select("row_id", *FEATURES), *fitted_detectors(train))


@query("score_models_agree", TEST + " select count(*) as n_rows, 0::bigint as n_different from te")
def score_models_agree(spark, sf):
    """Outputs beside each other are those of each model alone."""
    train, rest = parts(spark, sf)
    binary, classes, forest = fitted_detectors(train)
    every = M.score_models(rest.select("row_id", *FEATURES), binary, classes, forest)
    said = ["binary_prediction", "multiclass_label", "anomaly_flag"]
    first = binary.transform(every).select("row_id", *FEATURES, *said, F.col("prediction").cast("int").alias("a"))
    second = classes.transform(first).select("row_id", *FEATURES, *said, "a", F.col("predicted_label").alias("b"))
    third = forest.predict(second.withColumnRenamed("anomaly_flag", "flag")).select("row_id", *said[:2], "flag", "a", "b", F.col("anomaly_flag").alias("c"))
    return met_by_id(third, ["binary_prediction", "multiclass_label", "flag"], ["a", "b", "c"])


def met_by_id(rows, said, alone):
    """What joining, by row_id, the columns `said` with each column of `alone` in a table of its own gives: its rows, and how many
    of them differ in any pair. A row_id of n rows stands for n to the power of the number of tables; rows are shuffled once."""
    counts = rows.repartition("row_id").groupBy("row_id", *said, *alone).agg(F.count(F.lit(1)).alias("n"))  # of one id as many as there are answers
    groups = counts.groupBy("row_id").agg(F.collect_list(F.struct("n", *said, *alone)).alias("of"))

    def n_where(of, test):
        return F.aggregate(of, F.lit(0).cast("bigint"), lambda s, y: s + F.when(test(y), y["n"]).otherwise(0))

    def alike(x):
        found = x["n"]
        for a, b in zip(said, alone):
            found = found * n_where(F.col("of"), lambda y, a=a, b=b: F.coalesce(x[a] == y[b], F.lit(False)))
        return found

    one = F.size("of") == 1
    same = reduce(lambda p, q: p & q, [F.coalesce(F.col("of")[0][a] == F.col("of")[0][b], F.lit(False)) for a, b in zip(said, alone)])
    n, whole = n_where(F.col("of"), lambda y: F.lit(True)), F.lit(1).cast("bigint")
    for _ in range(len(alone) + 1):
        whole = whole * n
    agree = F.when(one & same, whole).when(one, 0).otherwise(F.aggregate("of", F.lit(0).cast("bigint"), lambda s, x: s + alike(x)))
    met = groups.where(F.col("row_id").isNotNull()).select(whole.alias("whole"), agree.alias("agree"))
    return met.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("whole") - F.col("agree")), F.lit(0)).alias("n_different"))


@query(
    "synthesise_minority",
    TEST + " select label, 1500 - count(*) as n_rows, 1500 - count(*) as n_inside from tr group by 1 having count(*) < 1000",
)
def synthesise_minority(spark, sf):
    train, _ = parts(spark, sf)
    return inside(Y.synthesise_minority(train, FEATURES), train)


@query(
    "smote",
    TEST + """, n as (select count(*) filter (label <> 'BENIGN') as attacks, count(*) filter (label = 'BENIGN') as benign from tr),
m as (select case when attacks < benign then 'ATTACK' else 'BENIGN' end as label, least(attacks, benign) as few, greatest(attacks, benign) as many from n)
select label, many - few as n_rows, many - few as n_inside from m where few > 1 and many > few""",
)
def smote(spark, sf):
    """Training rows of the rarer of ATTACK and BENIGN made up to the number of the other; no held-out row is used."""
    train, _ = parts(spark, sf)
    two = train.withColumn("label", F.when(F.col("label") == "BENIGN", "BENIGN").otherwise("ATTACK"))
    fewest = two.groupBy("label").count().orderBy("count", "label").first()["label"]
    return inside(N.smote(two, FEATURES, fewest, ratio=1.0), two)


@query(
    "knn_classify",
    """with e as (select cast(vec_id as varchar) as id, embedding::double[] as v, label from embeddings),
d as (select a.id, b.label, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as r from e a join e b on a.id <> b.id),
c as (select id, label, count(*) as n from d where r <= 5 group by 1, 2)
select id, label as predicted_label from c qualify row_number() over (partition by id order by n desc, label) = 1""",
)
def knn_classify(spark, sf):
    """Every vector classified by its 5 nearest others."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
    )
    return N.knn_classify(rows, rows, skip_self=True)
