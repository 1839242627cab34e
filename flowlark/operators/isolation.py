"""Isolation forest (Liu, Ting and Zhou, 2008) trained on benign rows.

Each tree grows from 256 rows in one small task; the forest, at most a few thousand nodes
per hundred trees, is broadcast; scoring looks up the leaf of a row's box in each tree, or walks the trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlark.functions.expr import col, hash_order
from flowlark.operators.scale import exact_quantile, first_rows
from flowlark.operators.trees import doubles
from flowlark.session import cut_lineage

#: Most boxes of a tree whose leaves are laid out, and rows to walk before they are.
MOST_BOXES, WALKED = 500_000, 20_000
NODES = "tree int, node int, feature int, threshold double, left int, right int, length double"


def average_path(n: float) -> float:
    """Mean length of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes as (node, feature, threshold, left, right, length); a leaf has feature -1."""
    nodes: list[tuple] = []
    open_nodes = [(0, rows, 0)]
    count = 1
    while open_nodes:
        node, part, depth = open_nodes.pop()
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
        usable = np.flatnonzero(high > low) if len(part) > 1 and depth < limit else []
        if len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(part))))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, count, count + 1, 0.0))
        open_nodes += [(count, part[goes_left], depth + 1), (count + 1, part[~goes_left], depth + 1)]
        count += 2
    return nodes


def path_lengths(rows: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Sum over the trees of each row's path length. A value that is not a number goes right.

    Both children of a leaf are the leaf itself, so that all rows take the same steps.
    """
    n = len(rows)
    flat, at_row, total = np.ascontiguousarray(rows.T).ravel(), np.arange(n), np.zeros(n)
    for tree in trees:
        inner, itself = tree["feature"] >= 0, np.arange(len(tree["feature"]))
        column = np.maximum(tree["feature"], 0) * n
        child = np.stack([np.where(inner, tree["right"], itself), np.where(inner, tree["left"], itself)], axis=1).ravel()
        node = np.zeros(n, dtype=np.int64)
        for _ in range(tree["depth"]):
            place = column.take(node)
            place += at_row
            low = flat.take(place) <= tree["threshold"].take(node)
            node *= 2
            node += low
            node = child.take(node)
        total += tree["length"].take(node)
    return total


class Paths:
    """Path lengths of rows in all trees.

    A tree sees nothing of a value but which of its thresholds lie below it. Where a tree's boxes of thresholds are few enough, as
    with three features, the leaf of each box is laid out once so many rows have been walked: a row then takes one look
    for each tree in place of a step for each level. The lengths are added in the same order either way.
    """

    def __init__(self, trees: list[dict], width: int, most: int = MOST_BOXES, walked: int = WALKED):
        self.trees, self.walked, self.least, self.tables = trees, 0, walked, None
        self.own = [[np.unique(t["threshold"][t["feature"] == f]) for f in range(width)] for t in trees]
        boxes = [float(np.prod([len(c) + 1.0 for c in own])) for own in self.own]
        self.few = bool(boxes) and max(boxes) <= most and sum(boxes) <= 100 * most

    def of(self, columns: list[np.ndarray]) -> np.ndarray:
        n = len(columns[0])
        if not self.few or (self.tables is None and self.walked + n <= self.least):
            self.walked += n
            return path_lengths(np.stack(columns, axis=1), self.trees)
        if self.tables is None:
            self.every = [np.unique(np.concatenate([own[f] for own in self.own])) for f in range(len(columns))]
            self.tables = [leaf_table(t, own, self.every) for t, own in zip(self.trees, self.own)]
        bins = [np.searchsorted(c, v, "left") for c, v in zip(self.every, columns)]
        total = np.zeros(n)
        for places, leaves, length in self.tables:
            at = places[0].take(bins[0])
            for place, b in zip(places[1:], bins[1:]):
                at += place.take(b)
            total += length.take(leaves.take(at))
        return total


def leaf_table(tree: dict, own: list[np.ndarray], every: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each feature what a place among the thresholds of all trees adds to the box number, the leaf of each box, and the lengths."""
    sizes = [len(c) + 1 for c in own]
    strides = [int(np.prod(sizes[f + 1 :])) for f in range(len(sizes))]
    places = [(np.searchsorted(np.searchsorted(g, c), np.arange(len(g) + 1)) * s).astype(np.int64) for g, c, s in zip(every, own, strides)]
    leaves = np.zeros(sizes, np.min_scalar_type(len(tree["feature"])))
    open_nodes = [(0, tuple((0, s) for s in sizes))]
    while open_nodes:
        node, box = open_nodes.pop()
        f = int(tree["feature"][node])
        if f < 0:
            leaves[tuple(slice(*b) for b in box)] = node
            continue
        cut = int(np.searchsorted(own[f], tree["threshold"][node])) + 1  # a value up to threshold i has a place up to i
        low, high = box[f]
        cut = min(max(cut, low), high)
        open_nodes += [(int(tree["left"][node]), (*box[:f], (low, cut), *box[f + 1 :])), (int(tree["right"][node]), (*box[:f], (cut, high), *box[f + 1 :]))]
    return places, leaves.ravel(), tree["length"]


#: The last forest this worker scored with, by the hash of its trees.
_PATHS: dict[str, Paths] = {}


def paths_with(key: str, make: Callable[[], Paths]) -> Paths:
    found = _PATHS.get(key)
    if found is None:
        found = make()
        _PATHS.clear()
        _PATHS[key] = found
    return found


@dataclass
class IsolationForest:
    features: list[str]
    sample: int
    trees: list[dict]
    offset: float

    def normal(self, spark: SparkSession) -> Column:
        """A score in (-1, 0] of a row with the features; the lower, the easier to isolate."""
        shared = spark.sparkContext.broadcast(self.trees)
        scale = average_path(self.sample)
        key = hashlib.sha256(b"".join(t[k].tobytes() for t in self.trees for k in ("feature", "threshold", "left", "right", "length"))).hexdigest()

        @F.arrow_udf("double")
        def score(*columns: pa.Array) -> pa.Array:
            lengths = paths_with(key, lambda: Paths(shared.value, len(columns))).of([doubles(c) for c in columns])
            return pa.array(-np.exp2(-lengths / len(shared.value) / scale))

        return score.asNondeterministic()(*[col(c).cast("double") for c in self.features])

    def normality(self, df: DataFrame, out: str = "normality") -> DataFrame:
        """Adds the score."""
        return df.withColumn(out, self.normal(df.sparkSession))

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds anomaly_flag (1 for anomalies) and anomaly_score (above 0 for anomalies)."""
        return self.flagged(self.normality(df), df.columns)

    def flagged(self, scored: DataFrame, kept: list[str]) -> DataFrame:
        """The columns to keep with the flag and score of `predict`, from the column normality."""
        score = F.lit(self.offset) - F.col("normality")
        return scored.select(*kept, F.when(score > 0, 1).otherwise(0).alias("anomaly_flag"), score.alias("anomaly_score"))


def fit_isolation_forest(
    df: DataFrame, features: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42
) -> IsolationForest:
    """Fits on `df` (row_id and features), which is written to the shared folder once, as are
    its scores, since both are read several times. The offset is the exact quantile of the training
    scores at `contamination`, so that share of training rows is flagged."""
    df = cut_lineage(df.select("row_id", *[col(c) for c in features]))
    key = F.concat(hash_order(F.col("row_id"), seed), F.lit("|"), F.col("row_id"))
    pool = first_rows(df, [], key, F.substring(hash_order(F.col("row_id"), seed), 1, 4), trees * sample)
    numbered = pool.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("tree").cast("string"), "row_id"))
    order = Window.partitionBy("tree").orderBy(mixed, "row_id")
    drawn = numbered.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).select("tree", "row_id")
    width = len(features)
    rows = drawn.join(pool, "row_id").select("tree", "row_id", F.array(*[col(c).cast("double") for c in features]).alias("x"))
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        ordered = part.sort_values("row_id")
        points = np.stack(ordered["x"].to_numpy()).reshape(-1, width)
        nodes = grow(points, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "threshold", "left", "right", "length"])

    nodes = rows.groupBy("tree").applyInPandas(build, NODES).toPandas().sort_values(["tree", "node"])
    grown = [
        {
            "feature": t["feature"].to_numpy(np.int64), "threshold": t["threshold"].to_numpy(), "left": t["left"].to_numpy(np.int64),
            "right": t["right"].to_numpy(np.int64), "length": t["length"].to_numpy(), "depth": limit,
        }
        for _, t in nodes.groupby("tree")
    ]
    used = min(sample, pool.count())
    forest = IsolationForest(features, used, grown, 0.0)
    scores = cut_lineage(forest.normality(df).select("normality"))
    forest.offset = exact_quantile(scores, [], "normality", contamination).first()["quantile"]
    return forest
