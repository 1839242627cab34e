"""Importance resampling towards a target: hashed word runs weigh a text, Gumbel noise draws without replacement.

Counts of features per bucket are added up over the whole corpus and over the target; their ratio
gives each bucket a gain, an array that scores every text. The draw keeps the k highest scores.
The k-th key is found by quickselect over the cluster: random keys of the rows still in question
are pivots, each round counts exactly what lies below, at and above each of them, and goes on
between two. Only rows up to the k-th key are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlark.llm.order import in_order
from flowlark.llm.text import BLOCK_BYTES, blocks, coded, pieces, raw_bytes, sums, word_ranges
from flowlark.session import cut_lineage

RUN, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Pivots of a round of the quickselect.
PIVOTS = 31

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that are in no word: all of ASCII but digits and lower-case letters.
GAPS = np.ones(256, bool)
GAPS[128:] = GAPS[ord("0") : ord("9") + 1] = GAPS[ord("a") : ord("z") + 1] = False


def feature_buckets(texts: pa.Array, run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every run of 1 to `run` words, where each text's runs begin, and its number of words."""
    bytes_, begins = raw_bytes(texts)
    bytes_ = LOWER[bytes_]
    starts, ends, firsts = word_ranges(bytes_, begins, GAPS)
    codes, distinct = coded(pieces(bytes_, starts, ends, pa.binary()))
    words = distinct.to_pylist()
    n_words = np.diff(firsts)
    text = np.repeat(np.arange(len(n_words)), n_words)
    found, owner = [], []
    gram, strings = codes, words
    for k in range(1, run + 1):
        if k > 1:
            # A longer run is a shorter one and the next word; only different runs are spelt out.
            inside = np.arange(len(gram)) + k - 1 < firsts[1:][text[: len(gram)]]
            inside[len(codes) - k + 1 :] = False
            at = np.flatnonzero(inside)
            pairs, back = np.unique(gram[at] * np.int64(max(len(words), 1)) + codes[at + k - 1], return_inverse=True)
            strings = [strings[a] + b" " + words[b] for a, b in zip((pairs // max(len(words), 1)).tolist(), (pairs % max(len(words), 1)).tolist())]
            gram = np.zeros(len(codes), np.int64)
            gram[at] = back
        else:
            at = np.arange(len(codes))
        hashes = np.fromiter((zlib.crc32(s) % buckets for s in strings), np.int64, len(strings))
        found.append(hashes[gram[at]] if len(at) else np.zeros(0, np.int64))
        owner.append(text[at])
    all_, of = np.concatenate(found), np.concatenate(owner)
    if run > 1:
        order = np.argsort(of, kind="stable")
        all_, of = all_[order], of[order]
    return all_, np.searchsorted(of, np.arange(len(n_words) + 1)), n_words


def bucket_counts(rows: DataFrame, run: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends at most one row per bucket."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for block in blocks(batches, BLOCK_BYTES):
            total += np.bincount(feature_buckets(block.column(0), run, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": total[some]})

    texts = rows.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most one row for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the source, rounded down."""
    s_all, t_all, buckets = int(source.sum()), int(target.sum()), len(source)
    ratio = ((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, run: int) -> DataFrame:
    """doc_id, n_features, n_words and weight (sum of the gains of its features) of each text."""
    buckets = len(gain)

    def score(batches) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            bucket, firsts, n_words = feature_buckets(block.column(1), run, buckets)
            yield pa.RecordBatch.from_pydict({"doc_id": block.column(0), "n_features": np.diff(firsts), "n_words": n_words, "weight": sums(gain[bucket], firsts)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(score, "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel value that follows from seed and doc_id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth_key(rows: DataFrame, keys: list[str], k: int, pivots: int = PIVOTS) -> tuple[int, ...]:
    """The k-th smallest composite key (k from 1) of at least k rows with long, non-null key columns.

    To the driver come the pivots of a round and a count for each of them and each gap between two.
    """
    key = F.struct(*keys)

    def at(values: tuple[int, ...]) -> Column:
        return F.struct(*(F.lit(v).cast("long") for v in values))

    above, below, turn = None, None, 0
    while True:
        open_ = rows.select(*keys)
        if above is not None:
            open_ = open_.where(key > at(above))
        if below is not None:
            open_ = open_.where(key < at(below))
        drawn = open_.orderBy(F.xxhash64(*keys, F.lit(turn)), *keys).limit(pivots).collect()
        chosen = sorted({tuple(r) for r in drawn})
        # An even slot is a gap between pivots, an odd one the pivot itself.
        slot = sum(((key > at(p)).cast("int") + (key >= at(p)).cast("int") for p in chosen[1:]), (key > at(chosen[0])).cast("int") + (key >= at(chosen[0])).cast("int"))
        counts = dict(open_.groupBy(slot.alias("slot")).count().collect())
        for i in range(2 * len(chosen) + 1):
            n = counts.get(i, 0)
            if k <= n:
                break
            k -= n
        if i % 2:
            return chosen[i // 2]
        above = chosen[i // 2 - 1] if i else above
        below = chosen[i // 2] if i // 2 < len(chosen) else below
        turn += 1


def importance_resample(
    docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs (doc_id, text); target has texts in `text`.

    Words are lower-cased for A-Z and are what lies between signs and spaces of ASCII. Of the N rows with at
    least `least_words` words, the floor(percent * N / 100) with the highest scores are drawn, ties to the
    smaller doc_id; rank is 1, 2, ... in that order and null for the others.

    A null or empty text has no features and weight 0. A row with a null doc_id adds to the counts of
    the source, has a null score and is never drawn. Rows that repeat a doc_id are drawn each by itself,
    of equal scores the one with fewer features first. Other columns are not looked at; an empty target
    weighs by the source alone; empty docs give an empty result.
    """
    gain = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    scored = weights(docs, gain, run).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = cut_lineage(scored.withColumn("worse", -F.col("score")))
    keys = ["worse", "doc_id", "n_features"]
    fit = scored.where((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull())
    k = percent * fit.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = kth_key(fit, keys, k)
    within = F.struct(*keys) <= F.struct(*(F.lit(v).cast("long") for v in last))
    drawn = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull() & within
    winners = in_order(scored.where(drawn), [F.col(c) for c in keys], "place")
    # Rows alike in the whole key may go beyond k; which of them is drawn makes no difference.
    rank = F.when(F.col("place") < k, F.col("place") + 1)
    others = scored.where(~F.coalesce(drawn, F.lit(False)))
    return winners.select(*columns, rank.alias("rank")).unionByName(others.select(*columns, F.lit(None).cast("long").alias("rank")))
