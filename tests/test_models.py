"""Models on separable rows, and neighbours, SMOTE and synthesis against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlark.operators import evaluate as E
from flowlark.operators import isolation as I
from flowlark.operators import models as M
from flowlark.operators import neighbors as N
from flowlark.operators import synthesis as Y
from flowlark.operators import tiles
from flowlark.operators import trees as T
from flowlark.operators.isolation import average_path, fit_isolation_forest
from flowlark.operators.rules import route_and_score
from flowlark.plans.q_models import met_by_id

X = ["x1", "x2"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(900):
        label = ("BENIGN", "DDoS", "WebAttack_XSS")[i % 3]
        center = {"BENIGN": (0, 0), "DDoS": (6, 0), "WebAttack_XSS": (0, 6)}[label]
        x = rng.normal(center, 1.0)
        data.append((f"r{i}", label, float(x[0]), float(x[1])))
    return spark.createDataFrame(data, "row_id string, label string, x1 double, x2 double").repartition(4).persist()


BINARY = {
    "forest": lambda r: M.rf_binary(r, X, trees=5, depth=5),
    "boosted": lambda r: M.gbt_binary(r, X, rounds=3, depth=3),
    "logistic": lambda r: M.logistic_regression(r, X),
    "tree": lambda r: M.decision_tree(r, X, depth=5),
    "net": lambda r: M.mlp(r, X, hidden=(8, 4), rounds=60),
}


@pytest.mark.parametrize("name", sorted(BINARY))
def test_binary_models_tell_attacks(spark, rows, name):
    scored = M.attack_probability(BINARY[name](rows).transform(rows))
    assert E.roc_auc(scored).first()[0] > 0.95


def test_class_models_tell_labels(spark, rows):
    for model in (M.rf_multiclass(rows, X, trees=5, depth=5), M.specialist(rows, X, ["WebAttack_XSS", "DDoS", "Bot"], rounds=2, depth=3)):
        hit = model.transform(rows).agg(F.avg((F.col("predicted_label") == F.col("label")).cast("int"))).first()[0]
        assert hit > 0.95


def test_boosted_stumps(spark, rows):
    stumps = M.adaboost(rows, X, rounds=6)
    assert E.binary_metrics(M.adaboost_score(rows, stumps)).first()["accuracy"] > 0.9


def test_stumps_are_those_of_a_plain_search(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 12, (400, 2)).astype(float)
    y = ((x[:, 0] > 5) ^ (rng.random(400) < 0.25)).astype(int)
    data = [(f"r{i}", "DDoS" if t else "BENIGN", float(a), float(b)) for i, ((a, b), t) in enumerate(zip(x, y))]
    got = M.adaboost(spark.createDataFrame(data, "row_id string, label string, x1 double, x2 double").repartition(5), X, rounds=8)
    weight = np.ones(400)
    for stump in got:
        best = None
        for f in range(2):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                sides = [[weight[s & (y == c)].sum() for c in (0, 1)] for s in (left, ~left)]
                e = sum(map(min, sides)) / weight.sum()
                if best is None or e < best[0] - 1e-9:
                    best = (e, f, cut, *(int(np.argmax(s)) for s in sides))
        e, f, cut, low, high = best
        assert (stump.feature, stump.cut, stump.low, stump.high) == (X[f], cut, low, high)
        assert stump.error == pytest.approx(e) and stump.vote == pytest.approx(np.log((1 - e) / e))
        weight = weight * np.exp(stump.vote * (np.where(x[:, f] <= cut, low, high) != y))
    assert len(got) == 8


def plain_tree(bins, target, weight, classes):
    """Calls of a full tree by exhaustive search, for its own rows; ties to the first feature and cut."""
    held = np.bincount(target, weight, classes)
    best = None
    if (held > 0).sum() > 1:
        for f in range(len(bins)):
            for cut in np.unique(bins[f])[:-1]:
                left = bins[f] <= cut
                cost = 0
                for s in (left, ~left):
                    h = np.bincount(target[s], weight[s], classes)
                    cost += h.sum() - (h * h).sum() / h.sum()
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, f, cut)
    out = np.tile(held / held.sum(), (len(target), 1))
    if best:
        left = bins[best[1]] <= best[2]
        for s in (left, ~left):
            out[s] = plain_tree(bins[:, s], target[s], weight[s], classes)
    return out


def test_trees_against_a_plain_search():
    rng = np.random.default_rng(2)
    for classes in (2, 4):
        bins, target = rng.integers(0, 9, (3, 250)).astype(np.uint8), rng.integers(0, classes, 250)
        sample = T.Sample(bins, target, rng.integers(1, 4, 250).astype(float))
        tree = T.grow_tree(sample, classes, 1, None, False, 3, False)
        assert T.tree_shares(tree, bins, classes) == pytest.approx(plain_tree(bins, target, sample.weight, classes), abs=1e-6)
        assert tree["importance"].sum() == pytest.approx(1) and (tree["importance"] > 0).all()
        assert len(T.grow_tree(sample, classes, 1, 2, True, 1, True)["feature"]) <= 7


def test_boosting_follows_gradients_and_hessians():
    rng = np.random.default_rng(3)
    bins, target = rng.integers(0, 30, (2, 500)).astype(np.uint8), rng.integers(0, 2, 500)
    sample = T.Sample(bins, target, np.ones(500))
    one = T.boost(sample, 2, 1, 1, 0.1, 1.0, 1.0, 1.0, 0.0, 1.0, 0)
    best = None
    for f in range(2):
        for cut in range(29):
            left = bins[f] <= cut
            parts = [((0.5 - target[s]).sum(), 0.25 * s.sum()) for s in (left, ~left)]
            gain = sum(g * g / (h + 1) for g, h in parts)
            if min(h for _, h in parts) >= 1 and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, cut, [-0.1 * g / (h + 1) for g, h in parts])
    assert (one["feature"][0, 0, 0], one["bin"][0, 0, 0]) == best[1:3]
    assert one["value"][0, 0] == pytest.approx(best[3], rel=1e-5)
    target = (bins[0] // 10 + (bins[1] > 15)).astype(np.int64)
    sample = T.Sample(bins, target, np.ones(500))
    losses = [-np.log(T.boosted_shares(T.boost(sample, 4, r, 3, 0.3, 1.0, 1.0, 1.0, 0.0, 1.0, 0), bins, 4)[np.arange(500), target]).mean() for r in (1, 5, 20)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.05


def test_models_do_not_depend_on_partitions_and_stand_odd_rows(spark, rows, tmp_path):
    first, second = (M.rf_binary(rows.repartition(n), X, trees=3, depth=6) for n in (1, 5))
    assert first.payloads == second.payloads
    M.save_model(first, str(tmp_path), {"a": 1})
    again, about = M.load_model(spark, str(tmp_path))
    odd = spark.createDataFrame([("a", None, 1.0), ("b", float("nan"), float("inf")), ("c", -1e300, None)], "row_id string, x1 double, x2 double")
    assert about == {"a": 1} and [r.probability for r in again.transform(odd).collect()] == [r.probability for r in first.transform(odd).collect()]
    assert first.transform(odd.limit(0)).collect() == []


def test_net_stops_early(spark, rows, monkeypatch):
    losses = iter([0.5, 0.3, 0.4, 0.45, 0.1])
    monkeypatch.setattr(M, "log_loss", lambda scored: next(losses))
    M.mlp(rows, X, hidden=(4,), rounds=100, every=2)
    assert next(losses) == 0.1  # two worse ones in a row end it


def test_importances_and_scope(spark, rows):
    got = M.feature_importance(spark, M.rf_binary(rows, X, trees=5, depth=4)).collect()
    assert len(got) == 2 and sum(r["importance"] for r in got) == pytest.approx(1.0)
    assert M.specialist_scope(["A", "B", "A"]) == ["A", "B"]
    assert M.specialist_scope(weak=["Bot"]) == ["Bot"]
    with pytest.raises(ValueError):
        M.specialist_scope(weak=[])


def test_scores_beside_the_rows(spark, rows):
    forest = fit_isolation_forest(rows.filter("label = 'BENIGN'"), X, trees=20)
    binary, classes = M.rf_binary(rows, X, trees=5, depth=4), M.gbt_multiclass(rows, X, rounds=2, depth=3)
    out = M.score_models(rows.select("row_id", *X), binary, classes, forest)
    assert out.count() == 900
    low, high = out.agg(F.min("multiclass_confidence"), F.max("multiclass_confidence")).first()
    assert 1 / 3 < low < high <= 1.0


def test_only_routed_rows_reach_the_specialist(spark, rows):
    sent = []

    def score(part):
        sent.append(part.count())
        return part.select("row_id", F.lit("Bot").alias("specialist_label"))

    flagged = rows.select("row_id", F.col("label").alias("general_label"), F.lit(0.9).alias("general_confidence"))
    out = route_and_score(flagged, score)
    assert sent == [300] and out.filter("final_label = 'Bot'").count() == 300 and out.count() == 900


def test_isolation_forest_flags_the_set_share(spark, rows):
    benign = rows.filter("label = 'BENIGN'")
    forest = fit_isolation_forest(benign, X)
    inside = forest.predict(benign).agg(F.avg("anomaly_flag")).first()[0]
    outside = forest.predict(rows.filter("label = 'DDoS'")).agg(F.avg("anomaly_flag")).first()[0]
    assert abs(inside - 0.05) < 0.01 and outside > 0.8
    again = fit_isolation_forest(benign.repartition(3), X)
    assert again.offset == forest.offset
    assert average_path(256) == pytest.approx(10.2447, abs=1e-3)


def vectors(spark, n=240, width=6):
    rng = np.random.default_rng(8)
    data = rng.integers(0, 4, (n, width)).astype(float)  # many ties
    rows = [(f"v{i:03d}", [float(x) for x in v], int(v[0])) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "id string, vector array<double>, label int")


@pytest.mark.parametrize("limits", [{}, {"max_bytes": 0, "block_rows": 50}])
def test_nearest_is_exact(spark, limits):
    data, df = vectors(spark)
    got = {}
    for r in N.nearest(df, df, 5, True, **limits).collect():
        got.setdefault(r["id"], []).append((round(r["distance"], 9), r["neighbor"]))
    for i, v in enumerate(data):
        gaps = np.sqrt(((data - v) ** 2).sum(axis=1))
        want = sorted((round(float(g), 9), f"v{j:03d}") for j, g in enumerate(gaps) if j != i)[:5]
        assert sorted(got[f"v{i:03d}"]) == want


def plain_nearest(data, rows, k, skip_self):
    """Sorted (query place, distance, neighbor) by comparing every pair."""
    out = []
    for place, (own, v) in enumerate(data):
        gaps = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if not (skip_self and i == own))
        out += [(own, round(g, 9), i) for g, i in gaps[:k]]
    return sorted(out)


def grid_rows(seed):
    """Groups on a coarse grid: many equal distances, equal vectors under several ids, rows that repeat, one vector with a third of all."""
    rng = np.random.default_rng(seed)
    near = [(f"n{i:03d}", [float(x) for x in rng.integers(0, 4, 3) + 40 * (i % 5)]) for i in range(240)]
    hot = [(f"h{i:03d}", [1.0, 1.0, 1.0]) for i in range(150)]
    return near + hot + near[:20] * 3 + hot[:2] * 9


@pytest.mark.parametrize("skip_self", [True, False])
def test_blocks_find_the_same_neighbours_with_ties_and_repeats(spark, skip_self):
    rows = grid_rows(3)
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    asked = rows[::7] + [("far", [500.0, -3.0, 0.0]), ("far", [500.0, -3.0, 0.0])]
    queries = spark.createDataFrame(asked, df.schema)
    want = plain_nearest(asked, rows, 4, skip_self)
    for limits in ({}, {"max_bytes": 0, "block_rows": 30}, {"max_bytes": 0, "block_rows": 1000}):
        found = N.nearest(queries, df, 4, skip_self, **limits).collect()
        assert sorted((r["id"], round(r["distance"], 9), r["neighbor"]) for r in found) == want


@pytest.mark.parametrize("alike", [True, False])
@pytest.mark.parametrize("skip_self", [True, False])
def test_tiles_find_the_same_neighbours_with_ties_and_repeats(spark, skip_self, alike):
    """wide rows beyond the broadcast went to blocks that no bound ruled out."""
    rng = np.random.default_rng(5)
    wide = [(f"w{i % 260:03d}", [float(x) for x in rng.integers(0, 2, 9) + 1000 * (i % 2)]) for i in range(300)]
    hot = [(f"h{i:03d}", [1.0] * 9) for i in range(80)] + [("h000", [1.0] * 9)] * 12
    rows = wide + hot + [("big", [1e200, -1e200] + [0.1] * 7), ("nothing", None)]
    asked = rows if alike else [*rows[::7], ("far", [500.0] * 9), ("far", [500.0] * 9)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    queries = df if alike else spark.createDataFrame(asked, df.schema)
    points, vectors = [(i, v) for i, v in asked if v], [(i, v) for i, v in rows if v]
    want = [r for r in plain_nearest(points, vectors, 4, skip_self) if np.isfinite(r[1])]
    for limits in ({"max_bytes": 0, "block_rows": 60}, {"max_bytes": 0}):
        found = N.nearest(queries, df, 4, skip_self, **limits).collect()
        assert sorted((r["id"], round(r["distance"], 9), r["neighbor"]) for r in found) == want


def test_a_tile_multiplies_each_pair_of_rows_once_for_both_directions(monkeypatch):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(3000, 16))
    calls = []
    monkeypatch.setattr(tiles, "close_pairs", lambda a, b, *more, find=tiles.close_pairs: calls.append(len(a) * len(b)) or find(a, b, *more))

    def side(some, slot):
        n = len(some)
        table = {"number": some, "own": some, "kept": np.ones(n, bool), "edge": np.full(n, 4.0), "slot": np.full(n, slot, np.int32)}
        return tiles.Side(pa.table({**table, "vector": pa.array(list(rows[some]))}), 16)

    a, b = side(np.arange(1000), 0), side(np.arange(1000, 3000), 1)
    found = sorted((n, m) for batch in tiles.compared(a, b, 3, True, True) for r in batch.to_pylist() for n, m in zip(r["number"], r["neighbor"]))
    gaps = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2))
    want = []
    for q in range(3000):
        others = np.arange(1000, 3000) if q < 1000 else np.arange(1000)
        want += [(q, int(r)) for r in others[np.argsort(gaps[q, others])][:3] if gaps[q, r] <= 4.0]
    assert found == sorted(want) and sum(calls) == 1000 * 2000


def test_only_blocks_within_reach_are_visited(spark):
    """Eight far groups: after the first block a query needs only blocks of its own group."""
    rng = np.random.default_rng(4)
    rows = [(f"r{i:04d}", [float(x) for x in rng.normal(0, 1, 4) + 1000 * (i % 8)]) for i in range(1600)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    blocks = N.Blocks(df, 1600, 4, 5, block_rows=50)
    placed = blocks.at_home(df).cache()
    first = N.closest(blocks.search(placed.select("q", "id", "vector", F.array("home").alias("blocks")), 5, True), 5)
    visits = blocks.others(placed, first, 5).agg(F.sum(F.size("blocks"))).first()[0]
    assert blocks.sizes.agg(F.max("n")).first()[0] <= 100 and blocks.sizes.count() >= 20
    assert visits < 1600 * blocks.sizes.count() / 4


def test_vectors_that_are_no_points_have_no_neighbours(spark):
    schema = "id string, vector array<double>"
    rows = [("a", [0.0, 1.0]), ("b", [0.0, 2.0]), ("c", None), ("d", [None, 1.0]), ("e", [float("nan"), 0.0]), ("f", [float("inf"), 0.0]), ("g", [1e200, -1e200])]
    df, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for limits in ({}, {"max_bytes": 0, "block_rows": 1}):
        found = sorted((r["id"], r["neighbor"], r["distance"]) for r in N.nearest(df, df, 3, True, **limits).collect())
        assert found == [("a", "b", 1.0), ("b", "a", 1.0)]  # the distance to g is beyond doubles
        assert N.nearest(none, df, 3, **limits).count() == 0 and N.nearest(df, none, 3, **limits).count() == 0


def test_vote_ties_go_to_the_smallest_label(spark):
    ref = spark.createDataFrame([("a", [0.0], 2), ("b", [1.0], 1), ("c", [9.0], 3)], "id string, vector array<double>, label int")
    query = spark.createDataFrame([("q", [0.4])], "id string, vector array<double>")
    assert N.knn_classify(query, ref, 2).first()["predicted_label"] == 1


def test_smote_rows_lie_between_neighbours(spark, rows):
    few = rows.filter("label = 'BENIGN'").unionByName(rows.filter("label = 'DDoS'").orderBy("row_id").limit(40))
    made = N.smote(few, X, "DDoS", ratio=0.5, k=3).toPandas()
    assert len(made) == 150 - 40 and made["row_id"].is_unique
    real = few.filter("label = 'DDoS'").toPandas().set_index("row_id")[X]
    counts = {}
    for _, r in made.iterrows():
        base = r["row_id"].split("-")[1]
        counts[base] = counts.get(base, 0) + 1
        a = real.loc[base].to_numpy()
        near = real.drop(base)
        near = near.loc[((near - a) ** 2).sum(axis=1).nsmallest(3).index].to_numpy()
        p = r[X].to_numpy(dtype=float)
        off = [abs((p - a)[0] * (b - a)[1] - (p - a)[1] * (b - a)[0]) for b in near]
        assert min(off) < 1e-9
    assert set(counts.values()) <= {2, 3}


def test_synthetic_rows_stay_in_range(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, 300)
    data = [(f"r{i}", "Weak", float(b), float(2 * b + rng.normal(0, 0.1)), int(rng.choice([1, 5, 9]))) for i, b in enumerate(base)]
    data += [(f"s{i}", "Strong", 0.0, 0.0, 1) for i in range(1200)]
    df = spark.createDataFrame(data, "row_id string, label string, a double, b double, c int")
    out = Y.synthesise_minority(df, ["a", "b", "c"]).toPandas()
    assert len(out) == 1200 and set(out["label"]) == {"Weak"} and set(out["c"]) <= {1, 5, 9}
    assert out["a"].between(base.min(), base.max()).all()
    assert np.corrcoef(out["a"], out["b"])[0, 1] > 0.9
    assert Y.augmented(df, ["a", "b", "c"]).count() == 1500 + 1200


def test_synthetic_rows_keep_modes_and_what_goes_with_them():
    """Two far modes, a discrete column tied to them, a correlation inside one mode: none of it blurs."""
    rng = np.random.default_rng(6)
    low = rng.random(400) < 0.3
    a = np.where(low, rng.normal(0, 0.5, 400), rng.normal(100, 2, 400))
    b = np.where(low, rng.normal(7, 1, 400), a * 3 + rng.normal(0, 0.5, 400))
    c = np.where(low, 1.0, rng.choice([5.0, 9.0], 400))
    rows = np.column_stack([a, b, c])
    made = Y.sample_like(rows, np.array([False, False, True]), 1100, np.random.default_rng(1))
    few = made[:, 0] < 50
    assert not ((made[:, 0] > a[low].max()) & (made[:, 0] < a[~low].min())).any()
    assert abs(few.mean() - low.mean()) < 0.01 and (made[few, 2] == 1).all() and set(made[~few, 2]) == {5.0, 9.0}
    assert made[few, 1].max() <= b[low].max() and np.corrcoef(made[~few, 0], made[~few, 1])[0, 1] > 0.8
    assert (made.min(axis=0) >= rows.min(axis=0)).all() and (made.max(axis=0) <= rows.max(axis=0)).all()


def test_states_are_drawn_by_their_shares():
    states = np.array([[0, 0]] * 50 + [[0, 1]] * 7 + [[1, 0]] * 43)
    drawn = states[Y.even_draw(states, 333, np.random.default_rng(2))]
    for state, n in (((0, 0), 50), ((0, 1), 7), ((1, 0), 43)):
        assert abs((drawn == state).all(axis=1).sum() - 333 * n / 100) < 1


@pytest.mark.parametrize("values, modes", [([3.0] * 40, 1), ([2.0], 1), (list(np.random.default_rng(7).normal(0, 1, 500)), 1)])
def test_one_mode_where_there_is_one(values, modes):
    assert len(set(Y.fit_modes(np.array(values)))) == modes


def nearest_by_brute_force(queries, rows, ids, own, k, skip_self):
    found = []
    for i, q in enumerate(queries):
        gap = N.distances(q[None], rows)[0]
        if skip_self:
            gap[ids == own[i]] = np.inf
        order = [j for j in np.lexsort((ids, gap))[:k] if np.isfinite(gap[j])]
        found += [(i, gap[j], ids[j]) for j in order]
    return sorted(found)


@pytest.mark.parametrize("width", [1, 3, 7, 8, 64])
def test_index_finds_what_brute_force_finds(width):
    """Ties, repeated rows, repeated ids, far offsets and a heavy tail."""
    rng = np.random.default_rng(width)
    for kind in range(4):
        rows = rng.normal(size=(500, width))
        if kind == 1:
            rows = np.round(rows)
        if kind == 2:
            rows = np.round(rows) * 1e6 + 1e9
        if kind == 3:
            rows[:, 0] = rng.pareto(0.5, size=500) * 100
        ids = np.array([f"v{i % (500 if kind % 2 else 300)}" for i in range(500)])
        for skip_self in (True, False):
            q, r, gap = N.Index(rows, ids, 5).search(rows, ids, skip_self)
            assert sorted(zip(q, gap, ids[r])) == nearest_by_brute_force(rows, rows, ids, ids, 5, skip_self)


def test_index_of_few_dimensions_compares_a_small_part_of_all_pairs(monkeypatch):
    """every query met every row, so minority rows against each other grew with the square of their number."""
    compared, squares = [], N.squares
    monkeypatch.setattr(N, "squares", lambda rows, queries: compared.append(rows.shape[1] * queries.shape[1]) or squares(rows, queries))
    rng = np.random.default_rng(3)
    shares = []
    for n in (5_000, 20_000):
        rows, ids = rng.normal(size=(n, 3)), np.array([f"v{i}" for i in range(n)])
        compared.clear()
        assert len(N.Index(rows, ids, 5).search(rows, ids, True)[0]) == 5 * n
        shares.append(sum(compared) / n)
    assert shares[1] < 4_000 and shares[1] < 2 * shares[0]


@pytest.mark.parametrize("sizes", [[6, 4, 9], [30], [5, 7]])
def test_all_rows_of_bins_score_as_by_walking(sizes):
    """each task walked all trees for every different row of bins it met."""
    rng = np.random.default_rng(21)
    sizes, n = np.array(sizes), len(sizes)
    bins = np.stack([rng.integers(0, s, 700) for s in sizes]).astype(np.uint8)
    every = np.stack([a.ravel() for a in np.meshgrid(*(np.arange(s) for s in sizes), indexing="ij")]).astype(np.uint8)
    for classes in (2, 3):
        sample = T.Sample(bins, rng.integers(0, classes, 700), rng.random(700))
        trees = [T.grow_tree(sample, classes, i, depth, True, 1, True) for i, depth in enumerate((None, None, 3, 0))]
        boosted = T.boost(sample, classes, 5, 4, 0.3, 0.8, 0.8, 1.0, 0.0, 1.0, 42)
        walked = {"forest": sum(T.tree_shares(t, every, classes).astype(float) for t in trees) / 4, "boosted": T.boosted_shares(boosted, every, classes)}
        for kind, want in walked.items():
            calls = []
            got = T.all_scores(kind, trees if kind == "forest" else [boosted], sizes, classes)
            assert np.abs(got - want).max() < 1e-14
            known = T.Scored(lambda b: calls.append(b.shape[1]), 1_000, sizes, lambda: got)
            known.walked = T.WALKED
            for _ in range(3):
                assert (known.of(every[:, ::-1]) == got[::-1]).all()
            assert not calls


def test_scores_are_worked_out_once_for_each_different_row_of_bins():
    """F4, F5, F6, F8, F9: every row walked all trees, however often its bins had been scored."""
    rng = np.random.default_rng(8)
    sample = T.Sample(rng.integers(0, 6, (3, 400)).astype(np.uint8), rng.integers(0, 3, 400), np.ones(400))
    tree, boosted = T.grow_tree(sample, 3, 1, 3, True, 1, False), T.boost(sample, 3, 4, 3, 0.1, 0.8, 0.8, 1.0, 0.0, 1.0, 42)
    for score in (lambda b: T.tree_shares(tree, b, 3), lambda b: T.boosted_shares(boosted, b, 3)):
        seen = []
        for most in (1_000, 50):  # with the smaller bound it starts anew now and then
            known = T.Scored(lambda b: seen.append(b.shape[1]) or score(b), most)
            for _ in range(20):
                bins = rng.integers(0, 6, (3, 100)).astype(np.uint8)
                assert (known.of(bins) == score(bins)).all()
            assert sum(seen) <= (216 if most == 1_000 else 2_000)
            seen.clear()
        wide = rng.integers(0, 6, (9, 100)).astype(np.uint8)
        assert (T.Scored(score).of(wide) == score(wide)).all() and len(T.Scored(score).of(wide[:, :0])) == 0


def test_adaboost_rounds_pass_over_counts_of_equal_bins(spark, monkeypatch):
    """each of the 50 rounds read every row of the table."""
    rng = np.random.default_rng(9)
    data = [(f"r{i}", "DDoS" if rng.random() < 0.2 + 0.15 * a else "BENIGN", float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 4, (600, 2)))]
    held, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: held.append(cut(df)) or held[-1])
    stumps = M.adaboost(spark.createDataFrame(data, "row_id string, label string, x1 double, x2 double").repartition(5), X, rounds=6)
    assert len(held) == 1 and held[0].count() <= 32
    weight, x = np.ones(600), np.array([d[2:] for d in data])
    t = np.array([d[1] != "BENIGN" for d in data])
    for s in stumps:
        wrong = np.where(x[:, X.index(s.feature)] <= s.cut, s.low, s.high) != t
        assert s.error == pytest.approx(weight[wrong].sum() / weight.sum())
        weight = weight * np.exp(s.vote * wrong)


def test_path_lengths_are_those_of_a_walk_row_by_row():
    """scoring of the isolation forest, with values that are not a number."""
    from flowlark.operators.isolation import grow, path_lengths

    rng = np.random.default_rng(10)
    rows, trees = rng.normal(size=(300, 3)), []
    rows[::7, 1], rows[3, 0] = np.nan, np.inf
    for _ in range(5):
        a = np.array(sorted(grow(rng.normal(size=(64, 3)), rng, 6)))
        trees.append({"feature": a[:, 1].astype(int), "threshold": a[:, 2], "left": a[:, 3].astype(int), "right": a[:, 4].astype(int), "length": a[:, 5], "depth": 6})
    expected = []
    for row in rows:
        expected.append(0.0)
        for tree in trees:
            node = 0
            while tree["feature"][node] >= 0:
                node = tree["left" if row[tree["feature"][node]] <= tree["threshold"][node] else "right"][node]
            expected[-1] += tree["length"][node]
    assert path_lengths(rows, trees).tolist() == expected and path_lengths(rows[:0], trees).tolist() == []


def test_all_models_are_asked_in_one_projection(spark, rows):
    forest = fit_isolation_forest(rows.filter("label = 'BENIGN'"), X, trees=5)
    binary, classes = M.rf_binary(rows, X, trees=3, depth=4), M.rf_multiclass(rows, X, trees=3, depth=4)
    given = rows.select("row_id", *X)
    out = M.score_models(given, binary, classes, forest)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan and "MapInPandas" not in plan
    got = {r.row_id: r for r in out.collect()}
    first = {r.row_id: r for r in binary.transform(given).collect()}
    second = {r.row_id: r for r in classes.transform(given).collect()}
    third = {r.row_id: r for r in forest.predict(given).collect()}
    for k, r in got.items():
        assert r.binary_prediction == first[k].prediction and r.binary_confidence == pytest.approx(max(first[k].probability), abs=6e-5)
        assert r.multiclass_label == second[k].predicted_label and r.anomaly_flag == third[k].anomaly_flag
    assert len(got) == len(first) == 900


@pytest.mark.parametrize("few", [True, False])
def test_looked_up_paths_are_the_walked_ones(few):
    rng, trees = np.random.default_rng(3), []
    for seed in range(12):
        part = np.c_[rng.integers(0, 9, 256), rng.random(256) * 100, 1 / rng.random(256)].astype(float)
        table = np.array(sorted(I.grow(part, np.random.default_rng(seed), 8)))
        names = ("feature", "threshold", "left", "right", "length")
        trees.append({n: c.astype(np.int64) if n in ("feature", "left", "right") else c for n, c in zip(names, table[:, 1:].T)} | {"depth": 8})
    data = np.c_[rng.integers(-1, 11, 500), rng.random(500) * 120 - 10, 1 / rng.random(500)].astype(float)
    data[:40, 0] = trees[0]["threshold"][rng.integers(0, len(trees[0]["threshold"]), 40)]  # values at thresholds
    data[3, 1], data[4, 2], data[5] = np.nan, np.inf, -np.inf
    paths = I.Paths(trees, 3, most=500_000 if few else 1, walked=0)
    assert np.array_equal(paths.of(list(data.T)), I.path_lengths(data, trees)) and (paths.tables is not None) == few


def test_answers_meet_as_joins_by_id_do(spark):
    rows = [("a", 1, 1, 2, 2), ("b", 1, 0, 2, 2), ("c", 1, 1, 2, 2), ("c", 0, 1, 2, 3), ("c", 0, 0, 3, 2), ("c", 0, 0, 3, 2), ("d", None, 1, 2, 2), (None, 1, 1, 2, 2), ("e", 1, 1, 2, 2), ("e", 1, 1, 2, 2)]
    df = spark.createDataFrame(rows, "row_id string, p int, a int, q int, b int")
    one, two, three = df.select("row_id", "p", "q"), df.select("row_id", "a"), df.select("row_id", "b")
    same = F.coalesce((F.col("p") == F.col("a")) & (F.col("q") == F.col("b")), F.lit(False))
    joined = one.join(two, "row_id").join(three, "row_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~same, 1)).alias("n_different"))
    for part in (df, df.limit(0)):
        got = met_by_id(part, ["p", "q"], ["a", "b"])
        assert got.schema.names == ["n_rows", "n_different"] and [f.dataType for f in got.schema] == [f.dataType for f in joined.schema]
        assert [tuple(r) for r in got.collect()] == ([tuple(r) for r in joined.collect()] if part is df else [(0, 0)])


def test_a_table_of_scores_is_laid_out_once_a_machine(tmp_path, monkeypatch):
    made = []

    def make():
        made.append(1)
        return np.arange(12.0).reshape(4, 3)

    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path},/nowhere")
    for _ in range(3):
        assert np.array_equal(T.shared_table("k", make), np.arange(12.0).reshape(4, 3))
    assert len(made) == 1
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path / "gone"))
    assert T.shared_table("k", make).shape == (4, 3) and len(made) == 2
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    monkeypatch.setattr(T.np, "save", lambda *a: (_ for _ in ()).throw(OSError("no room")))
    assert T.shared_table("other", make).shape == (4, 3) and len(made) == 3


def test_plain_boosting_takes_all_rows(spark):
    """it took 50,000 rows of each class, and so for equally frequent what are not."""
    rows = spark.range(150_000).select(F.col("id").cast("string").alias("row_id"), F.when(F.col("id") % 3 > 0, "BENIGN").otherwise("DDoS").alias("label"), F.lit(1.0).alias("x1"))
    model = M.gradient_boosting(rows, ["x1"], rounds=60, depth=1)
    assert model.transform(rows.limit(1)).first()["probability"][1] == pytest.approx(1 / 3, abs=0.01)


def test_boosting_over_all_rows_grows_the_trees_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE_CELLS", 20)
    monkeypatch.setattr(T, "MARGIN_ROUNDS", 3)
    rng = np.random.default_rng(12)
    x = rng.integers(0, 12, (3, 700)).astype(float)
    target = (rng.random(700) < 0.15 + 0.05 * x[0] + 0.1 * (x[1] > 7)).astype(int)
    x[2, :40] = np.nan
    data = [(*map(float, x[:, i]), int(target[i])) for i in range(700)] + [(None, None, None, 1)] * 3
    names = ["x1", "x2", "x3"]
    rows = spark.createDataFrame(data, "x1 double, x2 double, x3 double, target int")
    made = [T.fit_boosted_whole(rows.repartition(n), names, "target", 8, 3) for n in (1, 7)]
    assert made[0].payloads == made[1].payloads
    sample = T.gathered(rows, names, made[0].cuts, "target", None)
    plain, whole = T.boost(sample, 2, 8, 3, 0.1, 1.0, 1.0, 1.0, 0.0, 1.0, 0), T.unpacked(made[0].payloads[0])
    assert (plain["feature"] == whole["feature"]).all() and (plain["bin"] == whole["bin"]).all()
    assert whole["value"] == pytest.approx(plain["value"], rel=1e-5) and made[0].importance == pytest.approx(plain["importance"].tolist())
    none = T.fit_boosted_whole(rows.limit(0), names, "target", 2, 2)
    assert none.transform(rows.limit(1)).first()["probability"] == [0.5, 0.5]


def test_tallied_rows_measure_as_the_rows(spark):
    """the scored rows of each model were written to be measured."""
    rng = np.random.default_rng(5)
    p = [None, 0.05, 0.049999, 0.95, 1.0, 0.0, 0.15, 0.1 + 0.2, 0.35, *rng.random(400).tolist()]
    names = ["BENIGN", "DDoS", "PortScan", None]
    data = [(names[rng.integers(4)], names[rng.integers(4)], x) for x in p]
    rows = spark.createDataFrame(data, "true_label string, predicted_label string, probability double")
    few = E.tallied(rows, 5, 95, 5)
    assert few.count() < len(data) and few.agg(F.sum("n_rows")).first()[0] == len(data)
    assert E.threshold_sweep(few, 5, 95, 5, times="n_rows").collect() == E.threshold_sweep(rows, 5, 95, 5).collect()
    assert E.binary_metrics(few, "n_rows").collect() == E.binary_metrics(rows).collect() == E.binary_metrics(E.tallied(rows, probability=None), "n_rows").collect()
    for best in (False, True):
        assert M.model_comparison({"a": few}, best, "n_rows").collect() == M.model_comparison({"a": rows}, best).collect()


@pytest.mark.parametrize("most", [32, 0])
def test_votes_are_counted_with_ties_repeats_and_missing_labels(spark, monkeypatch, most):
    monkeypatch.setattr(N, "MOST_LABELS", most)
    ref = [("a", [0.0], "x"), ("a", [0.0], "y"), ("b", [1.0], None), ("c", [2.0], "y"), ("d", [9.0], "x"), ("e", [9.5], "x"), ("f", [8.0], None)]
    queries = [("p", [0.1]), ("p", [9.2]), ("q", [9.2]), ("r", [1.5]), ("s", None)]
    made = N.knn_classify(spark.createDataFrame(queries, "id string, vector array<double>"), spark.createDataFrame(ref, "id string, vector array<double>, label string"), 2)
    # Each of the two rows "a" has the labels of both.
    assert sorted(map(tuple, made.collect())) == [("p", "x"), ("q", "x"), ("r", None)]


def test_votes_of_an_id_are_one_row_when_exchanged(spark):
    """all neighbours of all ids were exchanged with their labels, then once more for each label, then once more for each id."""
    ref = spark.createDataFrame([(f"r{i}", [float(i)], "xy"[i % 2]) for i in range(9)], "id string, vector array<double>, label string")
    made = N.knn_classify(ref.select("id", "vector").repartition(3), ref, 5)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 1
