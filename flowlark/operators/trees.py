"""Forests and second-order boosting over binned features.

A training sample has a stated bound (its class caps). Its features are cut into at most 255 bins once;
the binned sample, a byte for each value, is all that is shipped. A forest's trees are dealt over the
cluster: each is grown by one task, level by level, all nodes of a level at once. A boosted model's
rounds follow from each other, so one task grows it from sums of gradients and hessians per (node,
feature, bin). One over all rows has no sample: its table is counted by bins, and all tasks add up the sums. Fitted trees are tables of a few bytes per node; scoring walks them in every task.
"""

from __future__ import annotations

import fcntl
import hashlib
import io
import json
import math
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.session import remove_folder, shared_folder

BINS = 255
LEAF = 255
#: Most rows of a training sample: what its caps allow with room for many classes.
MOST_ROWS = 2_000_000
#: Most rows of bins whose scores a task keeps, most values of a table of all rows of bins, and rows to walk before it is made.
MOST_CELLS, MOST_VALUES, WALKED = 500_000, 32_000_000, 50_000
#: Rows of bins in a piece of a counted table, and rounds of boosting between two writings of its margins.
PIECE_CELLS, MARGIN_ROUNDS = 50_000, 10
#: Models whose scores a worker keeps from task to task.
MOST_MODELS = 2


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpacked(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload)) as found:
        return {k: found[k] for k in found.files}


def cut_points(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """For each feature the different values at its quantiles, ascending; bin i holds values up to cut i."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = rows.select(*(F.col(f).cast("double").alias(f) for f in features)).approxQuantile(features, shares, 0.0005)
    return [np.unique(np.array(v, float)) for v in found]


def binned(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, one row per feature; null and not-a-number are in the last bin."""
    out = np.empty((len(cuts), len(columns[0]) if columns else 0), np.uint8)
    for i, (v, c) in enumerate(zip(columns, cuts)):
        out[i] = np.searchsorted(c, v, "left")
    return out


def doubles(column: pa.Array) -> np.ndarray:
    """Null is not-a-number."""
    return np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False), float)


def feature_arrays(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [doubles(batch.column(batch.schema.get_field_index(n))) for n in names]


def binned_rows(rows: DataFrame, features: list[str], cuts: list[np.ndarray], target: str) -> tuple[DataFrame, list[str]]:
    """target and the bins of every row, and the names of the bins."""
    names = [f"b{i}" for i in range(len(features))]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = binned(feature_arrays(batch, names), cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(b.astype(np.int16)) for b in made)], ["target", *names])

    wide = rows.select(F.col(target).cast("int").alias("target"), *(F.col(f).cast("double").alias(n) for f, n in zip(features, names)))
    return wide.mapInArrow(run, "target int, " + ", ".join(f"{n} smallint" for n in names)), names


@dataclass
class Sample:
    """A binned training sample: bins (feature x row), class numbers and weights."""

    bins: np.ndarray
    target: np.ndarray
    weight: np.ndarray


def gathered(rows: DataFrame, features: list[str], cuts: list[np.ndarray], target: str, weight: str | None) -> Sample:
    """The sample as bytes, one block for each partition; its size is checked first."""
    if rows.count() > MOST_ROWS:
        raise ValueError(f"a training sample may have {MOST_ROWS} rows; lower its caps")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = binned(feature_arrays(batch, features), cuts)
                t, w = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns[-3:-1])
                yield pa.RecordBatch.from_pydict({"payload": pa.array([packed(bins=made, target=t, weight=w)], pa.binary())})

    names = [F.col(f).cast("double").alias(f) for f in features]
    value = F.col(weight).cast("double") if weight else F.lit(1.0)
    # A fixed order of rows, however they are partitioned, makes the fitted model the same.
    keyed = rows.select(*names, F.col(target).cast("int").alias("__t"), value.alias("__w"), F.xxhash64(*features, target).alias("__o"))
    parts = [unpacked(r.payload) for r in keyed.repartition(8, "__o").sortWithinPartitions("__o").mapInArrow(run, "payload binary").collect()]
    if not parts:
        return Sample(np.zeros((len(features), 0), np.uint8), np.zeros(0, np.int64), np.zeros(0))
    return Sample(np.concatenate([p["bins"] for p in parts], axis=1), np.concatenate([p["target"] for p in parts]).astype(np.int64), np.concatenate([p["weight"] for p in parts]))


# --- growing ------------------------------------------------------------------------------------


def best_splits(bins: np.ndarray, node: np.ndarray, weights: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """For one feature: each node's least sum of child impurities (weight x Gini) and the last bin of its left side.

    weights: one row per class. Nodes that the feature cannot split get infinity.
    """
    key = node * np.int64(256) + bins
    found, place = np.unique(key, return_inverse=True)
    sums = np.stack([np.bincount(place, w, len(found)) for w in weights])
    of = found >> 8
    firsts = np.searchsorted(of, np.arange(n_nodes + 1))
    total = np.concatenate([np.zeros((len(weights), 1)), np.cumsum(sums, axis=1)], axis=1)
    left = total[:, 1:] - total[:, firsts[of]]
    right = total[:, firsts[of + 1]] - total[:, 1:]
    nl, nr = left.sum(axis=0), right.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = (nl - (left * left).sum(axis=0) / nl) + (nr - (right * right).sum(axis=0) / nr)
    last = np.zeros(len(found), bool)
    last[firsts[1:][firsts[1:] > firsts[:-1]] - 1] = True
    cost[last] = np.inf
    best, at = np.full(n_nodes, np.inf), np.full(n_nodes, -1, np.int64)
    if len(found):
        some = np.flatnonzero(firsts[1:] > firsts[:-1])
        best[some] = np.minimum.reduceat(cost, firsts[:-1][some])
        hit = np.flatnonzero(cost == best[of])
        first = np.r_[True, of[hit][1:] != of[hit][:-1]]
        at[of[hit][first]] = found[hit][first] & 255
    return best, at


def grow_tree(sample: Sample, classes: int, seed: int, depth: int | None, bootstrap: bool, per_split: int, balance: bool) -> dict[str, np.ndarray]:
    """One classification tree down to pure leaves (or `depth`): feature, bin, child and leaf shares, and importances.

    Nodes are numbered by level; the right child follows the left one. child of a leaf is its class,
    or, from `classes` on, the row of its shares.
    """
    rng = np.random.default_rng(seed)
    n_features, n = sample.bins.shape
    times = np.bincount(rng.integers(0, n, n), minlength=n) if bootstrap else np.ones(n)
    weight = sample.weight * times
    if balance:
        held = np.bincount(sample.target, times, classes)
        weight = weight * (times.sum() / (np.count_nonzero(held) * np.maximum(held, 1)))[sample.target]
    rows = np.flatnonzero(weight > 0)
    bins, target, weight = sample.bins[:, rows], sample.target[rows], weight[rows]
    feature, cut, child, shares, importance = [], [], [], [], np.zeros(n_features)
    node, active, level, next_id, n_shares = np.zeros(len(rows), np.int64), 1, 0, 1, 0
    while active:
        held = np.bincount(node * classes + target, weight, active * classes).reshape(active, classes)
        whole = held.sum(axis=1)
        impurity = whole - (held * held).sum(axis=1) / np.maximum(whole, 1e-300)
        pure = (held > 0).sum(axis=1) <= 1
        best, where, which = np.full(active, np.inf), np.full(active, -1, np.int64), np.full(active, -1, np.int64)
        if depth is None or level < depth:
            turn = np.argsort(rng.random((active, n_features)), axis=1) if per_split < n_features else np.tile(np.arange(n_features), (active, 1))
            # First the drawn features; a node that none of them splits looks at the others.
            for tried in (turn[:, :per_split], turn[:, per_split:]):
                open_ = ~pure & ~np.isfinite(best)
                if not tried.shape[1] or not open_.any():
                    continue
                looks = np.zeros((active, n_features), bool)
                np.put_along_axis(looks, tried, True, axis=1)
                looks &= open_[:, None]
                for f in np.flatnonzero(looks.any(axis=0)).tolist():
                    mine = np.flatnonzero(looks[:, f][node])
                    by_class = np.zeros((classes, len(mine)))
                    by_class[target[mine], np.arange(len(mine))] = weight[mine]
                    cost, at = best_splits(bins[f, mine], node[mine], by_class, active)
                    better = (cost < best) & looks[:, f]
                    best[better], where[better], which[better] = cost[better], at[better], f
        splits = np.isfinite(best)
        np.add.at(importance, which[splits], (impurity - best)[splits])
        mixed_ = ~splits & ~pure
        leaf = held.argmax(axis=1)
        leaf[mixed_] = classes + n_shares + np.arange(int(mixed_.sum()))
        n_shares += int(mixed_.sum())
        shares.append(held[mixed_] / whole[mixed_, None])
        rank = np.cumsum(splits) - 1
        feature.append(np.where(splits, which, LEAF).astype(np.uint8))
        cut.append(np.where(splits, where, 0).astype(np.uint8))
        child.append(np.where(splits, next_id + 2 * rank, leaf).astype(np.int32))
        stay = splits[node]
        rows_, node = np.flatnonzero(stay), node[stay]
        right = bins[which[node], rows_] > where[node]
        bins, target, weight = bins[:, rows_], target[rows_], weight[rows_]
        node = 2 * rank[node] + right
        active = 2 * int(splits.sum())
        next_id += active
        level += 1
    total = importance.sum()
    return {
        "feature": np.concatenate(feature), "bin": np.concatenate(cut), "child": np.concatenate(child),
        "shares": np.concatenate(shares).astype(np.float32), "importance": importance / total if total else importance,
    }


def tree_shares(tree: dict[str, np.ndarray], bins: np.ndarray, classes: int) -> np.ndarray:
    """Class shares of each row, by walking the tree."""
    at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while len(rows):
        f = tree["feature"][at[rows]]
        inner = f != LEAF
        rows, f = rows[inner], f[inner]
        here = at[rows]
        at[rows] = tree["child"][here] + (bins[f, rows] > tree["bin"][here])
    values = np.concatenate([np.eye(classes, dtype=np.float32), tree["shares"].reshape(-1, classes)])
    return values[tree["child"][at]]


def boost(sample: Sample, classes: int, rounds: int, depth: int, step: float, share: float, columns: float, least: float, gamma: float, penalty: float, seed: int) -> dict[str, np.ndarray]:
    """Second-order boosting of the log-loss: logistic for two classes, softmax for more.

    A round draws `share` of the rows and `columns` of the features and grows one tree for each class, all of
    them together: nodes of all classes are counted in one pass over a feature. Trees are complete, a node without
    a split passes all rows to the left. least: smallest hessian sum of a child; gamma: least gain of a split.
    """
    rng = np.random.default_rng(seed)
    n_features, n = sample.bins.shape
    k = 1 if classes == 2 else classes
    inner, leaves = 2**depth - 1, 2**depth
    margin = np.zeros((k, n))
    out = {"feature": np.zeros((rounds, k, inner), np.uint8), "bin": np.full((rounds, k, inner), 255, np.uint8), "value": np.zeros((rounds, k, leaves), np.float32)}
    importance = np.zeros(n_features)
    onehot = (sample.target[None, :] == (np.arange(k)[:, None] if k > 1 else 1)).astype(float)
    for r in range(rounds):
        if k == 1:
            p = 1 / (1 + np.exp(-margin))
        else:
            e = np.exp(margin - margin.max(axis=0))
            p = e / e.sum(axis=0)
        rows = np.flatnonzero(rng.random(n) < share) if share < 1 else np.arange(n)
        used = np.sort(rng.choice(n_features, max(1, round(columns * n_features)), replace=False))
        g = ((p - onehot) * sample.weight)[:, rows].ravel()
        h = (np.maximum(p * (1 - p), 1e-16) * (2 if k > 1 else 1) * sample.weight)[:, rows].ravel()
        at = np.zeros((k, n), np.int64)  # the node of each row in its level
        for level in range(depth):
            width = 1 << level
            key = (at[:, rows] + np.arange(k)[:, None] * width).ravel()
            nodes = k * width

            def sums() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
                for f in used.tolist():
                    slot = key * 256 + np.tile(sample.bins[f, rows].astype(np.int64), k)
                    yield f, *(np.bincount(slot, v, nodes * 256).reshape(nodes, 256) for v in (g, h))

            gain, which, cut = best_cuts(sums(), nodes, least, gamma, penalty)
            split = cut < 255
            np.add.at(importance, which[split], gain[split])
            base = width - 1
            out["feature"][r, :, base : base + width] = which.reshape(k, width)
            out["bin"][r, :, base : base + width] = cut.reshape(k, width)
            for c in range(k):
                w, b = which.reshape(k, width)[c], cut.reshape(k, width)[c]
                at[c] = 2 * at[c] + (sample.bins[w[at[c]], np.arange(n)] > b[at[c]])
        leaf = (at[:, rows] + np.arange(k)[:, None] * leaves).ravel()
        gs, hs = (np.bincount(leaf, v, k * leaves) for v in (g, h))
        value = (-step * gs / (hs + penalty)).reshape(k, leaves)
        out["value"][r] = value
        margin += np.take_along_axis(value, at, axis=1)
    total = importance.sum()
    return {**out, "importance": importance / total if total else importance}


def best_cuts(sums: Iterable[tuple[int, np.ndarray, np.ndarray]], nodes: int, least: float, gamma: float, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and last bin of the left side of each node's best split; bin 255 where none gains more than gamma.

    sums: features, each with its sums of gradients and of hessians per (node, bin).
    """
    gain, which, cut = np.full(nodes, gamma), np.zeros(nodes, np.int64), np.full(nodes, 255, np.int64)
    for f, g, h in sums:
        gs, hs = g.cumsum(axis=1), h.cumsum(axis=1)
        gt, ht = gs[:, -1:], hs[:, -1:]
        found = 0.5 * (gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty))
        found[(hs < least) | (ht - hs < least)] = -np.inf
        place = found[:, :255].argmax(axis=1)
        value = found[np.arange(nodes), place]
        better = value > gain
        gain[better], which[better], cut[better] = value[better], f, place[better]
    return gain, which, cut


def boosted_shares(model: dict[str, np.ndarray], bins: np.ndarray, classes: int) -> np.ndarray:
    """Class probabilities of each row."""
    rounds, k, inner = model["feature"].shape
    depth, n = (inner + 1).bit_length() - 1, bins.shape[1]
    margin, rows, flat = np.zeros((k, n)), np.arange(n), np.ascontiguousarray(bins).ravel()
    for r in range(rounds):
        for c in range(k):
            column, cut, at = model["feature"][r, c].astype(np.int64) * n, model["bin"][r, c], np.zeros(n, np.int64)
            for level in range(depth):
                first, last = (1 << level) - 1, (2 << level) - 1
                place = column[first:last].take(at)
                place += rows
                right = flat.take(place) > cut[first:last].take(at)
                at *= 2
                at += right
            margin[c] += model["value"][r, c].take(at)
    return margin_shares(margin)


def margin_shares(margin: np.ndarray) -> np.ndarray:
    """Class probabilities, a row each, from margins, a column each."""
    if len(margin) == 1:
        p = 1 / (1 + np.exp(-margin[0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(margin - margin.max(axis=0))
    return (e / e.sum(axis=0)).T


# --- all rows of bins at once -------------------------------------------------------------------


def tree_boxes(tree: dict[str, np.ndarray], sizes: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The box of bins (low, high: first bin beyond) of each leaf of a tree, and its class shares."""
    feature, cut, child = tree["feature"], tree["bin"].astype(np.int64), tree["child"].astype(np.int64)
    low, high = np.zeros((len(feature), len(sizes)), np.int64), np.tile(sizes, (len(feature), 1))
    level = np.zeros(1, np.int64)
    while len(level):
        level = level[feature[level] != LEAF]
        halved(low, high, level, child[level], feature[level], cut[level])
        level = np.concatenate([child[level], child[level] + 1])
    leaf = feature == LEAF
    values = np.concatenate([np.eye(classes, dtype=np.float32), tree["shares"].reshape(-1, classes)])
    return low[leaf], high[leaf], values[child[leaf]]


def halved(low: np.ndarray, high: np.ndarray, at: np.ndarray, left: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> None:
    """Sets the boxes of the children, `left` and the node after it, of each node `at`."""
    low[left], low[left + 1], high[left], high[left + 1] = low[at], low[at], high[at], high[at]
    high[left, feature] = np.minimum(high[left, feature], cut + 1)
    low[left + 1, feature] = np.maximum(low[left + 1, feature], cut + 1)


def boosted_boxes(model: dict[str, np.ndarray], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Boxes of the leaves of each tree, and what they add to the margins."""
    rounds, k, inner = model["feature"].shape
    places = np.arange(inner)
    for r in range(rounds):
        for c in range(k):
            low, high = np.zeros((2 * inner + 1, len(sizes)), np.int64), np.tile(sizes, (2 * inner + 1, 1))
            for level in range((inner + 1).bit_length() - 1):
                at = places[(1 << level) - 1 : (2 << level) - 1]
                halved(low, high, at, 2 * at + 1, model["feature"][r, c, at], model["bin"][r, c, at].astype(np.int64))
            value = np.zeros((inner + 1, k), np.float32)
            value[:, c] = model["value"][r, c]
            yield low[inner:], high[inner:], value


def painted(boxes: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], bound: float, sizes: np.ndarray, width: int) -> np.ndarray:
    """For each row of bins (numbered with the last feature fastest) the sum of the values of all boxes around it; bound: no sum is greater.

    Each box marks its corners; running sums along every feature fill it. Values are whole numbers of a fine unit, so that the sums
    are exact whatever their order.
    """
    unit = 2.0 ** (61 - int(np.ceil(np.log2(bound + 1))))
    wide = sizes + 1
    stride = np.r_[np.cumprod(wide[::-1])[::-1][1:], 1].astype(np.int64)
    marks = [np.zeros(int(wide.prod()), np.int64) for _ in range(width)]
    for low, high, values in boxes:
        whole = (low < high).all(axis=1)
        for c in range(width):
            some = np.flatnonzero((values[:, c] != 0) & whole)
            value = np.rint(values[some, c].astype(float) * unit).astype(np.int64)
            ends = (low[some] * stride, high[some] * stride)
            for corner in range(1 << len(sizes)):
                of = [corner >> f & 1 for f in range(len(sizes))]
                np.add.at(marks[c], sum(ends[e][:, f] for f, e in enumerate(of)), -value if sum(of) % 2 else value)
    out = np.empty((int(sizes.prod()), width))
    for c in reversed(range(width)):
        filled = marks.pop().reshape(wide)
        for axis in range(len(sizes)):
            np.cumsum(filled, axis=axis, out=filled)
        out[:, c] = filled[tuple(slice(0, n) for n in sizes)].ravel() / unit
    return out


def all_scores(kind: str, trees: list[dict[str, np.ndarray]], sizes: np.ndarray, classes: int) -> np.ndarray:
    """Class probabilities of every row of bins."""
    if kind == "forest":
        out = painted((tree_boxes(t, sizes, classes) for t in trees), len(trees), sizes, classes)
        out /= len(trees)
        return out
    bound = float(np.abs(trees[0]["value"]).max(axis=(1, 2)).sum())
    margins = painted(boosted_boxes(trees[0], sizes), bound, sizes, trees[0]["feature"].shape[1])
    out = np.empty((len(margins), max(2, margins.shape[1])))
    for at in range(0, len(out), MOST_CELLS):
        out[at : at + MOST_CELLS] = margin_shares(margins[at : at + MOST_CELLS].T)
    return out


class Scored:
    """Class probabilities by bins, worked out once for each different row of bins.

    A model sees nothing of a row but its bins, at most 256 for each feature. Where the rows of bins there can be are few enough,
    as with three features, `every` gives the scores of them all in a time that does not depend on the table; it is called once so many
    rows have been walked. Otherwise different rows are kept as they come: beyond MOST_CELLS of them it starts anew, and beyond
    seven features every row is scored.
    """

    def __init__(self, score: Callable[[np.ndarray], np.ndarray], most: int = MOST_CELLS, sizes: np.ndarray | None = None, every: Callable[[], np.ndarray] | None = None):
        self.score, self.most, self.sizes, self.every = score, most, sizes, every
        self.codes, self.values = np.zeros(0, np.int64), None
        self.walked, self.table = 0, None

    def looked_up(self, bins: np.ndarray) -> np.ndarray:
        place = np.zeros(bins.shape[1], np.int64)
        for b, n in zip(bins, self.sizes.tolist()):
            place = place * n + b
        return self.table[place]

    def of(self, bins: np.ndarray) -> np.ndarray:
        if not 0 < len(bins) <= 7 or not bins.shape[1]:
            return self.score(bins)
        if self.table is not None:
            return self.looked_up(bins)
        code = np.zeros(bins.shape[1], np.int64)
        for b in bins:
            code = code * 256 + b
        if len(self.codes) > self.most:
            self.codes, self.values = np.zeros(0, np.int64), None
        at = np.searchsorted(self.codes, code)
        new = np.ones(len(code), bool)
        inside = at < len(self.codes)
        new[inside] = self.codes[at[inside]] != code[inside]
        if new.any():
            fresh, first = np.unique(code[new], return_index=True)
            self.walked += len(fresh)
            if self.every and self.walked > WALKED:
                self.table, self.codes, self.values = self.every(), None, None
                self.score = self.every = None  # with them go the unpacked trees
                return self.looked_up(bins)
            made = self.score(bins[:, np.flatnonzero(new)[first]])
            place = np.searchsorted(self.codes, fresh)
            self.codes = np.insert(self.codes, place, fresh)
            self.values = made if self.values is None else np.insert(self.values, place, made, axis=0)
            at = np.searchsorted(self.codes, code)
        return self.values[at]


def shared_table(key: str, make: Callable[[], np.ndarray]) -> np.ndarray:
    """A table that the first worker of a machine makes and all others map from the folder Spark gives them for scratch files.

    The others wait for it. Without such a folder, or room in it, a worker has its own.
    """
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    if not os.path.isdir(folder):
        return make()
    path = f"{folder}/scores-{key}.npy"
    made = None
    try:
        with open(f"{path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)  # goes with its owner
            if not os.path.exists(path):
                made = make()
                np.save(f"{path}.part.npy", made)
                os.replace(f"{path}.part.npy", path)
        return np.asarray(np.load(path, mmap_mode="r"))
    except OSError:
        return make() if made is None else made


#: The last models this worker scored with, by the hash of what they hold.
_SCORED: dict[str, Scored] = {}


def scored_with(key: str, make: Callable[[], Scored]) -> Scored:
    found = _SCORED.pop(key, None) or make()
    while len(_SCORED) >= MOST_MODELS:
        del _SCORED[next(iter(_SCORED))]
    _SCORED[key] = found
    return found


# --- models ---------------------------------------------------------------------------------------


@dataclass
class TreeModel:
    """A fitted forest ("forest") or boosted model ("boosted"): one payload for each tree, or one in all.

    Models for two classes 0 and 1 have no labels.
    """

    kind: str
    features: list[str]
    cuts: list[np.ndarray]
    classes: int
    payloads: list[bytes]
    labels: list[str] | None = None
    importance: list[float] = field(default_factory=list)

    def shares(self, spark: SparkSession) -> Column:
        """The class probabilities of a row with the features, as an array. Only the features go to Python, and what is asked for in one
        projection, by whichever models, goes there together. A worker lays a model out once, however often it is asked."""
        shared = spark.sparkContext.broadcast(self.payloads)
        kind, cuts, classes = self.kind, self.cuts, self.classes
        key = hashlib.sha256(b"".join([f"{kind} {classes} {[len(c) for c in cuts]}".encode(), *(c.tobytes() for c in cuts), *self.payloads])).hexdigest()

        def scorer() -> Scored:
            trees, sizes = [unpacked(p) for p in shared.value], np.array([len(c) + 1 for c in cuts], np.int64)
            every = (lambda: shared_table(key, lambda: all_scores(kind, trees, sizes, classes))) if np.prod(sizes.astype(float)) * classes <= MOST_VALUES else None
            if kind == "forest":
                return Scored(lambda bins: sum(tree_shares(t, bins, classes).astype(float) for t in trees) / len(trees), MOST_CELLS, sizes, every)
            return Scored(lambda bins: boosted_shares(trees[0], bins, classes), MOST_CELLS, sizes, every)

        @F.arrow_udf("array<double>")
        def score(*columns: pa.Array) -> pa.Array:
            p = scored_with(key, scorer).of(binned([doubles(c) for c in columns], cuts))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * classes, pa.int32()), pa.array(np.ascontiguousarray(p).ravel()))

        # Not deterministic only in name: no filter or later use works it out a second time.
        return score.asNondeterministic()(*(F.col(n).cast("double") for n in self.features))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction, probability (an array) and, with labels, predicted_label."""
        return self.called(df.withColumn("probability", self.shares(df.sparkSession)))

    def called(self, scored: DataFrame) -> DataFrame:
        """Adds prediction and, with labels, predicted_label to rows that have their probability."""
        best = F.array_position("probability", F.array_max("probability")) - 1
        if self.classes == 2 and self.labels is None:
            best = (F.col("probability")[1] > 0.5).cast("int")
        scored = scored.withColumn("prediction", best.cast("double"))
        if self.labels is None:
            return scored
        return scored.withColumn("predicted_label", F.element_at(F.array(*(F.lit(x) for x in self.labels)), (F.col("prediction") + 1).cast("int")))

    def save(self, folder: str, spark: SparkSession) -> None:
        about = {"kind": self.kind, "features": self.features, "cuts": [c.tolist() for c in self.cuts], "classes": self.classes, "labels": self.labels, "importance": self.importance}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/shape")
        spark.createDataFrame(list(enumerate(map(bytearray, self.payloads))), "tree int, payload binary").write.mode("overwrite").parquet(f"{folder}/trees")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> TreeModel:
        about = json.loads(spark.read.text(f"{folder}/shape").first()["value"])
        rows = spark.read.parquet(f"{folder}/trees").collect()
        payloads = [bytes(r.payload) for r in sorted(rows, key=lambda r: r.tree)]
        return TreeModel(about["kind"], about["features"], [np.array(c) for c in about["cuts"]], about["classes"], payloads, about["labels"], about["importance"])


def fit_forest(rows: DataFrame, features: list[str], target: str, classes: int, weight: str | None = None, trees: int = 100, depth: int | None = None, per_split: int | None = None, bootstrap: bool = True, balance: bool = False, seed: int = 42) -> TreeModel:
    """A forest of trees grown to pure leaves, each by one task on its own bootstrap of the sample.

    target: class numbers from 0. per_split: features a node draws, by default the square root of their number.
    balance: weigh classes by their share of each bootstrap.
    """
    cuts = cut_points(rows, features)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(gathered(rows, features, cuts, target, weight))
    drawn = per_split or max(1, int(len(features) ** 0.5))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                made = grow_tree(shared.value, classes, seed * 100_003 + i, depth, bootstrap, drawn, balance)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([i], pa.int32()), "payload": pa.array([packed(**{k: v for k, v in made.items() if k != "importance"})], pa.binary()), "importance": pa.array([made["importance"].tolist()])})

    numbers = spark.range(0, trees, 1, trees).select(F.col("id").cast("int").alias("tree"))
    grown = sorted(numbers.mapInArrow(run, "tree int, payload binary, importance array<double>").collect(), key=lambda r: r.tree)
    shared.unpersist()
    importance = np.mean([r.importance for r in grown], axis=0).tolist()
    return TreeModel("forest", features, cuts, classes, [bytes(r.payload) for r in grown], importance=importance)


def fit_boosted(rows: DataFrame, features: list[str], target: str, classes: int, weight: str | None = None, rounds: int = 200, depth: int = 6, step: float = 0.1, share: float = 0.8, columns: float = 0.8, least: float = 1.0, gamma: float = 0.0, penalty: float = 1.0, seed: int = 42) -> TreeModel:
    """A boosted model of the log-loss over the sample."""
    cuts = cut_points(rows, features)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(gathered(rows, features, cuts, target, weight))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = boost(shared.value, classes, rounds, depth, step, share, columns, least, gamma, penalty, seed)
                yield pa.RecordBatch.from_pydict({"payload": pa.array([packed(**{k: v for k, v in made.items() if k != "importance"})], pa.binary()), "importance": pa.array([made["importance"].tolist()])})

    grown = spark.range(0, 1, 1, 1).mapInArrow(run, "payload binary, importance array<double>").first()
    shared.unpersist()
    return TreeModel("boosted", features, cuts, classes, [bytes(grown.payload)], importance=list(grown.importance))


class Counted:
    """All rows of a table, counted by bins and class (0 or 1), with the margin of each row of bins.

    A row of the written table is a piece: how many rows it counts, and the bins, counts and margins of its rows of bins.
    """

    def __init__(self, rows: DataFrame, features: list[str], cuts: list[np.ndarray], target: str):
        self.spark, self.width = rows.sparkSession, len(features)
        self.base, self.number, self.folder = f"{shared_folder(self.spark).rstrip('/')}/counted-{uuid.uuid4().hex}", 0, None
        made, names = binned_rows(rows, features, cuts, target)
        n = [F.count(F.when(F.col("target") == c, 1)) for c in (0, 1)]
        counts = made.groupBy(*names).agg(n[0].alias("n0"), n[1].alias("n1"))

        def piece(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            *bins, n0, n1 = (np.concatenate(c) for c in zip(*held))
            counts = np.stack([n0, n1, np.zeros(len(n0))]).astype(float)
            return pa.RecordBatch.from_pydict({"n": [int(counts.sum())], "bins": [np.stack(bins).astype(np.uint8).tobytes()], "counts": [counts.tobytes()]})

        def run(batches) -> Iterator[pa.RecordBatch]:
            held, many = [], 0
            for batch in batches:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                many += batch.num_rows
                if many >= PIECE_CELLS:
                    yield piece(held)
                    held, many = [], 0
            if many:
                yield piece(held)

        self.written(counts.mapInArrow(run, "n long, bins binary, counts binary"))
        self.n = self.pieces.agg(F.sum("n")).first()[0] or 0

    def written(self, pieces: DataFrame) -> None:
        """Takes the place of what was written before, which goes."""
        self.number, last = self.number + 1, self.folder
        self.folder = f"{self.base}/{self.number}"
        pieces.write.parquet(self.folder)
        self.pieces = self.spark.read.schema("n long, bins binary, counts binary").parquet(self.folder)
        if last:
            remove_folder(self.spark, last)

    def removed(self) -> None:
        remove_folder(self.spark, self.base)


def opened(batches, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each piece of a counted table how many rows it counts, its bins (feature x cell), and its counts of both classes and margins."""
    for batch in batches:
        for n, bins, counts in zip(*(c.to_pylist() for c in batch.columns)):
            yield n, np.frombuffer(bins, np.uint8).reshape(width, -1), np.frombuffer(counts).reshape(3, -1).copy()


def leaves_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row of bins reaches after so many levels of a complete tree."""
    at, flat, rows = np.zeros(bins.shape[1], np.int64), np.ascontiguousarray(bins).ravel(), np.arange(bins.shape[1])
    for level in range(levels):
        f, c = (x[(1 << level) - 1 : (2 << level) - 1][at] for x in (feature, cut))
        at = 2 * at + (flat[f.astype(np.int64) * bins.shape[1] + rows] > c)
    return at


def fit_boosted_whole(rows: DataFrame, features: list[str], target: str, rounds: int = 100, depth: int = 3, step: float = 0.1, least: float = 1.0, gamma: float = 0.0, penalty: float = 1.0) -> TreeModel:
    """A boosted model of the log-loss of classes 0 and 1 over all rows and features, without a sample.

    It grows the trees that `boost` grows from all rows. They are counted by bins once, as equal bins have equal gradients. For each
    level every task sends one sum per (feature, node, bin) to the driver; sums are whole numbers of a fine unit, so their order makes no
    difference. A task works out the margins from those last written and the trees since, at most MARGIN_ROUNDS.
    """
    cuts = cut_points(rows, features)
    table = Counted(rows, features, cuts, target)
    unit = 2.0 ** (51 - math.ceil(math.log2(table.n + 1)))
    width, inner, leaves = len(features), 2**depth - 1, 2**depth
    out = {"feature": np.zeros((rounds, 1, inner), np.uint8), "bin": np.full((rounds, 1, inner), 255, np.uint8), "value": np.zeros((rounds, 1, leaves), np.float32)}
    importance = np.zeros(width)

    def sums_of(trees: list[tuple], feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        """Sums of gradients and of hessians per (feature, node, bin) of a level, from all tasks."""
        shape = (2, width, 1 << level, 256)

        def run(batches) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for _, bins, (n0, n1, margin) in opened(batches, width):
                p = 1 / (1 + np.exp(-added(margin, bins, trees)))
                n = n0 + n1
                made = np.rint((p * n - n1) * unit), np.rint(np.maximum(p * (1 - p), 1e-16) * n * unit)
                key = leaves_of(bins, feature, cut, level) * 256
                for f in range(width):
                    for at, v in enumerate(made):
                        total[at, f] += np.bincount(key + bins[f], v, 256 << level).reshape(1 << level, 256)
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        found = table.pieces.mapInArrow(run, "sums binary").collect()  # one row of sums for each task
        return sum((np.frombuffer(r.sums).reshape(shape) for r in found), np.zeros(shape)) / unit

    def grown(batches, trees: list[tuple]) -> Iterator[pa.RecordBatch]:
        for n, bins, counts in opened(batches, width):
            counts[2] = added(counts[2], bins, trees)
            yield pa.RecordBatch.from_pydict({"n": [n], "bins": [bins.tobytes()], "counts": [counts.tobytes()]})

    try:
        since: list[tuple] = []  # trees that are not in the written margins
        for r in range(rounds):
            if len(since) == MARGIN_ROUNDS:
                table.written(table.pieces.mapInArrow(lambda batches, trees=since: grown(batches, trees), "n long, bins binary, counts binary"))
                since = []
            feature, cut = out["feature"][r, 0], out["bin"][r, 0]
            for level in range(depth):
                nodes = 1 << level
                g, h = sums_of(since, feature, cut, level)
                gain, which, last = best_cuts(((f, g[f], h[f]) for f in range(width)), nodes, least, gamma, penalty)
                split = last < 255
                np.add.at(importance, which[split], gain[split])
                feature[nodes - 1 : 2 * nodes - 1], cut[nodes - 1 : 2 * nodes - 1] = which, last
            # A leaf has the sums of its side of the last split; without one all rows are on the left.
            left = [x[which, np.arange(nodes)].cumsum(axis=1)[np.arange(nodes), last] for x in (g, h)]
            gs, hs = (np.stack([x, y[0].sum(axis=1) - x], axis=1).ravel() for x, y in zip(left, (g, h)))
            value = -step * gs / (hs + penalty)
            out["value"][r, 0] = value
            since.append((feature, cut, value))
    finally:
        table.removed()
    total = importance.sum()
    return TreeModel("boosted", features, cuts, 2, [packed(**out)], importance=(importance / total if total else importance).tolist())


def added(margin: np.ndarray, bins: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Margins with what complete trees (features, bins, values of the leaves) add to them."""
    for feature, cut, value in trees:
        margin = margin + value[leaves_of(bins, feature, cut, len(value).bit_length() - 1)]
    return margin
