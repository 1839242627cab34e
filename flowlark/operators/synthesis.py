"""Synthetic rows for weak classes: modes and discrete values first, then values inside the modes.

A weak class has fewer rows than the limit, so one group is small by definition.
"""

from __future__ import annotations

import math
import zlib
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.functions.expr import col
from flowlark.operators.sampling import augmentation_plan
from flowlark.operators.scale import checked_small

FEW_VALUES = 50
MODES = 10
#: Least width of a mode, as a share of its column's spread.
LEAST_WIDTH = 1e-3


def fit_modes(values: np.ndarray, most: int = MODES, rounds: int = 100) -> np.ndarray:
    """The mode of each value under a mixture of normal curves, modes numbered upwards by mean.

    The number of modes, up to `most`, is the one with the least Bayesian information criterion.
    """
    count, spread = len(values), values.std()
    if not spread > 0:
        return np.zeros(count, dtype=int)
    x = (values - values.mean()) / spread
    best, chosen = np.inf, np.zeros(count, dtype=int)
    for k in range(1, min(most, count) + 1):
        mean, width, weight = np.quantile(x, (np.arange(k) + 0.5) / k), np.full(k, 1.0 / k), np.full(k, 1.0 / k)
        before = -np.inf
        for _ in range(rounds):
            logs = np.log(weight) - np.log(width) - 0.5 * ((x[:, None] - mean) / width) ** 2
            top = logs.max(axis=1, keepdims=True)
            sums = np.exp(logs - top).sum(axis=1, keepdims=True)
            fit = float((top + np.log(sums)).sum()) - 0.5 * count * math.log(2 * math.pi)
            part = np.exp(logs - top) / sums
            held = part.sum(axis=0) + 1e-9
            weight, mean = held / held.sum(), part.T @ x / held
            width = np.sqrt((part * (x[:, None] - mean) ** 2).sum(axis=0) / held + LEAST_WIDTH**2)
            if fit - before < 1e-6 * count:
                break
            before = fit
        cost = (3 * k - 1) * math.log(count) - 2 * fit
        if cost < best:
            place = np.argsort(np.argsort(mean, kind="stable"), kind="stable")
            best, chosen = cost, np.unique(place[part.argmax(axis=1)], return_inverse=True)[1]
    return chosen


def even_draw(states: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n row numbers; rows of a state of share s are drawn n x s times, rounded up or down."""
    order = np.lexsort((rng.permutation(len(states)), *states.T[::-1]))
    return order[((np.arange(n) + rng.random()) * len(states) / n).astype(int)]


def sample_like(rows: np.ndarray, discrete: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n rows like the given ones: first a state, then values under the condition of the state.

    A state is a discrete column's value and a continuous column's mode, over all columns together. States are
    drawn with the shares of the given rows, so combinations that do not occur are not made. Inside its mode a continuous
    column has the values' own margin; rank means and correlations are those of the state, drawn towards those of all rows
    by as many rows as there are columns, so that small states rest on the others.
    """
    count, width = rows.shape
    states = np.column_stack([np.unique(rows[:, j], return_inverse=True)[1] if discrete[j] else fit_modes(rows[:, j]) for j in range(width)])
    normal, scores = NormalDist(), np.zeros((count, width))
    margins: dict[tuple[int, int], np.ndarray] = {}
    for j in range(width):
        for m in range(states[:, j].max() + 1):
            at = np.flatnonzero(states[:, j] == m)
            at = at[rows[at, j].argsort(kind="stable")]
            margins[j, m] = rows[at, j]
            if not discrete[j]:
                scores[at, j] = [normal.inv_cdf((i + 0.5) / len(at)) for i in range(len(at))]
    spread = scores.std(axis=0)
    scores = scores / np.where(spread > 0, spread, 1.0)
    pooled = scores.T @ scores / count * 0.999 + np.eye(width) * 0.001
    chosen = even_draw(states, n, rng)
    kinds, kind = np.unique(states, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    drawn = rng.standard_normal((n, width))
    for s in range(len(kinds)):
        at, own = np.flatnonzero(kind[chosen] == s), scores[kind == s]
        mean = own.sum(axis=0) / (len(own) + width)
        cov = ((own - mean).T @ (own - mean) + width * pooled) / (len(own) + width)
        drawn[at] = mean + drawn[at] @ np.linalg.cholesky(cov).T
    share = 0.5 * (1.0 + np.vectorize(math.erf, otypes=[float])(drawn / math.sqrt(2.0)))
    chosen = states[chosen]
    out = np.empty((n, width))
    for (j, m), known in margins.items():
        at = np.flatnonzero(chosen[:, j] == m)
        out[at, j] = np.interp(share[at, j] * (len(known) - 1), np.arange(len(known)), known)
    return out


def synthesise_minority(df: DataFrame, features: list[str], weak_below: int = 1000, target: int = 1500, seed: int = 42) -> DataFrame:
    """New rows (row_id, label, features) bringing each weak class to the target."""
    plan = checked_small(augmentation_plan(df, weak_below, target).select("label", "synth_count"))
    weak = df.join(plan, "label").select("label", "synth_count", "row_id", *[col(c) for c in features])
    whole = [isinstance(df.schema[c].dataType, T.IntegralType) for c in features]
    shape = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("label", T.StringType())] + [T.StructField(c, df.schema[c].dataType) for c in features])

    def make(part: pd.DataFrame) -> pd.DataFrame:
        label = part["label"].iloc[0]
        ordered = part.sort_values("row_id")
        rows = ordered[features].to_numpy(dtype=np.float64)
        discrete = np.array([w and len(np.unique(rows[:, j])) < FEW_VALUES for j, w in enumerate(whole)])
        rng = np.random.default_rng([seed, zlib.crc32(label.encode())])
        new = pd.DataFrame(sample_like(rows, discrete, int(part["synth_count"].iloc[0]), rng), columns=features)
        for j, c in enumerate(features):
            if whole[j]:
                new[c] = new[c].round().astype("int64")
        new.insert(0, "label", label)
        new.insert(0, "row_id", [f"made-{label}-{i}" for i in range(len(new))])
        return new

    return weak.groupBy("label").applyInPandas(make, shape)


def augmented(df: DataFrame, features: list[str], **limits) -> DataFrame:
    """Real and synthetic rows together, told apart by `synthetic`."""
    made = synthesise_minority(df, features, **limits).withColumn("synthetic", F.lit(1))
    real = df.select("row_id", "label", *[col(c) for c in features], F.lit(0).alias("synthetic"))
    return real.unionByName(made)
