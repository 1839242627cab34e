"""Toxicity of texts: a bidirectional recurrent network over words and their characters.

A word's vector is the sum of a row for the word and the mean of rows for its character
trigrams, both found by hash. Windows of words overlap and cover the whole text; a text is as
toxic as its most toxic window, in training as in scoring: each step works on the window of a
text that scores highest at that moment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlark.llm import gru
from flowlark.llm.lm_score import lowered
from flowlark.llm.text import BLOCK_BYTES, blocks, coded, mixed, pieces, raw_bytes, word_hashes, word_ranges

WINDOW, STRIDE = 32, 24
FOLDS, HELD = 5, 0
#: The most labelled rows of each class, and bytes of text in all, that are learnt from.
ROWS = {0: 6000, 1: 3000}
SAMPLE_BYTES = 64 << 20
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Windows scored at a time.
GROUP = 1024


class Words:
    """The words of some texts, and where to find their vectors."""

    def __init__(self, texts: pa.Array):
        bytes_, begins = raw_bytes(texts)
        bytes_ = lowered(bytes_)
        starts, ends, self.firsts = word_ranges(bytes_, begins)
        self.codes, distinct = coded(pieces(bytes_, starts, ends, pa.binary()))
        self.word = (word_hashes(distinct) % np.uint64(gru.WORD_ROWS)).astype(np.int64)
        # trigrams of <word>, so that beginnings and ends differ from what lies inside
        own, at = raw_bytes(distinct)
        n = np.diff(at)
        edged = np.full(len(own) + 2 * len(n), 60, np.uint8)
        place = np.arange(len(own)) + np.repeat(2 * np.arange(len(n)) + 1, n)
        edged[place] = own
        edged[at[1:] + 2 * np.arange(len(n)) + 1] = 62
        self.char_firsts = at + 2 * np.arange(len(at))
        triple = edged.astype(np.uint64)
        triple[:-2] |= (triple[1:-1] << np.uint64(8)) | (triple[2:] << np.uint64(16))
        inside = np.ones(len(edged), bool)
        inside[self.char_firsts[1:] - 1] = inside[self.char_firsts[1:] - 2] = False
        self.char = (mixed(triple[inside], 31) % np.uint64(gru.CHAR_ROWS)).astype(np.int64)
        self.char_firsts = np.r_[0, np.cumsum(n)]  # a word of n bytes has n trigrams

    def vectors(self, p: gru.Parameters, some: np.ndarray | None = None) -> np.ndarray:
        """Vectors of all different words, or of some."""
        some = np.arange(len(self.word)) if some is None else some
        out = p["word"][self.word[some]].copy()
        for at in range(0, len(some), 1 << 15):
            rows, chars, many = self.chars(some[at : at + (1 << 15)])
            if len(chars):
                out[at : at + len(many)] += np.add.reduceat(p["char"][chars], rows) / many[:, None].astype(np.float32)
        return out

    def chars(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First entry, rows of the table and number of trigrams of each of some words."""
        many = np.diff(self.char_firsts)[some]
        rows = np.cumsum(many) - many
        return rows, self.char[np.repeat(self.char_firsts[some] - rows, many) + np.arange(many.sum())], many

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, words and presence of each window; a text without words has one empty window."""
        n = np.diff(self.firsts)
        many = np.maximum(1, 1 + -(-np.maximum(n - WINDOW, 0) // STRIDE))
        doc = np.repeat(np.arange(len(n)), many)
        place = (STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)))[:, None] + np.arange(WINDOW)
        there = place < n[doc][:, None]
        at = np.where(there, self.firsts[:-1][doc][:, None] + place, 0)
        return doc, self.codes[at] if len(self.codes) else np.zeros_like(at), there


def fitted(words: Words, label: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> gru.Parameters:
    """The network after some epochs over labelled texts."""
    p, draw = gru.fresh(), np.random.default_rng(seed)
    dense = [k for k in p if k not in gru.TABLES]
    first, second = ({k: np.zeros_like(p[k]) for k in dense} for _ in range(2))
    rates = {k: np.full(len(p[k]), 1e-3, np.float32) for k in gru.TABLES}
    doc, window, there = words.windows()
    bounds = np.searchsorted(doc, np.arange(len(label) + 1))
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(label))
        for at in range(0, len(order), BATCH):
            texts = order[at : at + BATCH]
            some = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in texts])
            used, local = np.unique(window[some], return_inverse=True)
            local = local.reshape(len(some), WINDOW)
            vectors = words.vectors(p, used) if len(words.word) else np.zeros((1, gru.WIDTH), np.float32)
            gates = gru.word_gates(p, vectors)
            score = np.concatenate([gru.logits(p, gates, local[k : k + GROUP], there[some[k : k + GROUP]]) for k in range(0, len(some), GROUP)])
            ends = np.cumsum(bounds[texts + 1] - bounds[texts])
            best = np.array([a + int(np.argmax(score[a:b])) for a, b in zip(np.r_[0, ends[:-1]], ends)])
            _, g, dv = gru.gradients(p, vectors, local[best], there[some[best]], label[texts])
            step += 1
            for k in dense:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                p[k] -= (RATE * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step) * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
            if len(words.word):
                moved = np.flatnonzero(dv.any(axis=1))
                rows, chars, many = words.chars(used[moved])
                share = np.repeat(dv[moved] / many[:, None].astype(np.float32), many, axis=0)
                for table, at_, change in (("word", words.word[used[moved]], dv[moved]), ("char", chars, share)):
                    near, back = np.unique(at_, return_inverse=True)
                    total = np.zeros((len(near), gru.WIDTH), np.float32)
                    np.add.at(total, back, change)
                    rates[table][near] += (total**2).mean(axis=1)
                    p[table][near] -= 5 * RATE * total / np.sqrt(rates[table][near])[:, None]
    return p


def scored(p: gru.Parameters, words: Words) -> np.ndarray:
    """The highest window probability of each text."""
    doc, window, there = words.windows()
    gates = gru.word_gates(p, words.vectors(p)) if len(words.word) else np.zeros((1, 6 * gru.HIDDEN), np.float32)
    found = [gru.logits(p, gates, window[k : k + GROUP], there[k : k + GROUP]) for k in range(0, len(doc), GROUP)]
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
    return gru.sigmoid(np.maximum.reduceat(np.concatenate(found).astype(np.float64), heads)) if len(doc) else np.zeros(0)


def fold_of(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of a bounded sample of the labelled rows that may be learnt from.

    Each class keeps the share of its rows, by a hash of doc_id, that its bound in ROWS allows, and
    all the share that SAMPLE_BYTES allows. So few label rows are safe to broadcast.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    usable = usable.where(fold_of(F.col("id")) != HELD)
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    share = F.lit(0.0)
    for r in usable.groupBy("toxic").count().collect():  # two classes
        share = F.when(F.col("toxic") == r.toxic, min(1.0, ROWS[r.toxic] / r["count"])).otherwise(share)
    few = usable.where(place < share).select("id", "toxic", place.alias("place"))
    sample = docs.join(F.broadcast(few), docs["doc_id"] == few["id"]).select("text", "toxic", "place", share.alias("share"))
    size = sample.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return sample.where(F.col("place") < F.col("share") * min(1.0, SAMPLE_BYTES / max(size, 1))).select("text", "toxic") if size > SAMPLE_BYTES else sample.select("text", "toxic")


def trained(sample: DataFrame) -> gru.Parameters:
    """The network fitted to a bounded sample, in one task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            rows = pa.Table.from_batches(parts).sort_by("text").combine_chunks().to_batches()[0]
            p = fitted(Words(rows.column(0)), rows.column(1).to_numpy(zero_copy_only=False).astype(np.float32))
            yield pa.RecordBatch.from_pydict({"name": list(p), "w": [x.tobytes() for x in p.values()]})

    p = gru.fresh()
    for r in sample.select(F.coalesce("text", F.lit("")).alias("text"), "toxic").repartition(1).mapInArrow(run, "name string, w binary").collect():  # one model
        p[r["name"]] = np.frombuffer(r["w"], np.float32).reshape(p[r["name"]].shape)
    return p


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text); whole texts are scored.

    labels: doc_id, toxic (0 or 1; a repeated doc_id is toxic if one of its rows is; other values and
    null ids are left out). Only labels of rows whose crc32(doc_id) leaves no HELD by FOLDS are learnt
    from, at most ROWS of each class and SAMPLE_BYTES of text. Without labels the network is untrained.
    A null text counts as empty: one window without words; a null doc_id counts as the empty text for
    the fold; repeated rows give repeated results; other columns are not looked at; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p = trained(labelled_sample(rows, labels))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            score = scored(p, Words(block.column(1)))
            yield pa.RecordBatch.from_pydict({"doc_id": block.column(0), "score": score})

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id")) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
