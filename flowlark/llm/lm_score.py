"""Language-model scores: a causal self-attention model over subword ids, beside a word unigram base.

Counts come from every training text. The words of a block go once each to the bucket of their
hash; the texts' own word counts follow and leave as partial sums, so no vocabulary is gathered.
The attention model predicts a class of the next subword; how likely the subword is in its class
comes from counts given the class before it. All training texts are dealt into shards of about
SHARD_TOKENS subwords, so a larger corpus has more of them. Shard after shard, tasks train copies
on its whole texts and the copies are averaged slice by slice; each of ROUNDS rounds takes all shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowlark.llm import attention as net
from flowlark.llm.fertility import vocabulary
from flowlark.llm.text import BLOCK_BYTES, blocks, coded, joined_counts, owners, pieces, raw_bytes, sums, word_hashes, word_ranges
from flowlark.llm.windows import PACKED, numbered, packed, unpacked
from flowlark.session import cut_lineage, shared_folder

#: Of the crc32 of the doc_id as text: the remainder by FOLDS that is held out.
FOLDS, HELD = 5, 1
CLASSES, INPUTS = 128, 4096
#: Times that every training text is gone through, and how fast and in how many windows at once it is learnt from.
ROUNDS, RATE, BATCH = 2, 0.004, 32
#: Training subwords between two averages, about how many of them a copy gets, and the least number of shards.
SHARD_TOKENS, COPY_TOKENS, LEAST_SHARDS = 32_000_000, 500_000, 4
SLICES = 64
#: Parts of the counts of pairs, and how many tokens the corpus share in a class weighs against them.
PAIR_SLICES, SHARE_WEIGHT = 16, 10.0
SHARDS = "shard int, slot int, payload binary"
#: What the buckets of words give: packed sums for the texts of a block, or (block null) totals and subword counts.
ANSWERS = "block long, payload binary, tag int, id long, known long, n long"
TOTALS, SUBWORDS = -1, -2


def fold(doc_ids: list) -> np.ndarray:
    """The remainder of each doc_id; a null one counts as the empty text."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in doc_ids), np.int64, len(doc_ids))


def lowered(bytes_: np.ndarray) -> np.ndarray:
    return bytes_ + 32 * ((bytes_ >= 65) & (bytes_ <= 90)).astype(np.uint8)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the lower-case words, the words, and the first word of each text."""
    bytes_, begins = raw_bytes(texts)
    bytes_ = lowered(bytes_)
    starts, ends, firsts = word_ranges(bytes_, begins)
    return *coded(pieces(bytes_, starts, ends)), firsts


def shipped(block: pa.RecordBatch, buckets: int, number: int) -> Iterator[tuple]:
    """For each bucket the block's words with their training counts, then the counts of its texts.
    The end of a text is the word that has no bytes."""
    train = fold(block.column(0).to_pylist()) != HELD
    codes, distinct, firsts = words_of(block.column(2))
    texts, end = [*distinct.cast(pa.binary()).to_pylist(), b""], len(distinct)
    doc = np.r_[owners(firsts), np.arange(block.num_rows)]
    codes = np.r_[codes, np.full(block.num_rows, end)]
    seen = np.bincount(codes[train[doc]], minlength=end + 1)
    doc, word, n = joined_counts(doc, codes)
    bucket = np.r_[(word_hashes(distinct) % np.uint64(buckets)).astype(np.int64), 0]
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    held = np.argsort(place[word], kind="stable")
    here = np.unique(bucket)
    edges = np.searchsorted(bucket[order], np.stack([here, here + 1]))
    for b, lo, hi, begin, stop in zip(here.tolist(), *edges.tolist(), *np.searchsorted(place[word][held], edges).tolist()):
        own = [texts[i] for i in order[lo:hi].tolist()]
        yield b, 0, number, packed(b"".join(own), np.fromiter(map(len, own), np.int32, len(own)), seen[order[lo:hi]])
        some = held[begin:stop]
        some = some[np.argsort(doc[some], kind="stable")]
        yield b, 1, number, packed((place[word[some]] - lo).astype(np.int32), doc[some].astype(np.int32), n[some].astype(np.int32))


def summed(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Partial sums of the texts, totals and subword counts, for the sorted rows of some buckets."""
    bucket, count, total, parts = None, {}, None, {}
    known: np.ndarray | None = None

    def batch(block, payload, tag, id_, seen, n) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((block, payload, tag, id_, seen, n), kinds)], names=[c.split()[0] for c in ANSWERS.split(", ")])

    def close() -> Iterator[pa.RecordBatch]:
        yield batch([None], [None], [TOTALS], [0], [int((known > 0).sum())], [int(known.sum())])
        encode, is_byte = vocabulary(path)
        some = [w for w in count if w]
        ids, many = encode([w.decode() for w in some])
        times = np.repeat(known[[count[w] for w in some]] if some else np.zeros(0, np.int64), many)
        tokens = np.bincount(ids, times, len(is_byte) + 1)
        tokens[-1] += known[count[b""]] if b"" in count else 0  # the end is the id after all others
        at = np.flatnonzero(tokens)
        none = [None] * len(at)
        yield batch(none, none, np.full(len(at), SUBWORDS), at, np.zeros(len(at), np.int64), tokens[at].astype(np.int64))

    for rows_ in rows:
        for b, kind, number, payload in zip(*(rows_.column(i).to_pylist() for i in range(4))):
            if kind == 2:
                yield batch([number], [payload], [1], [0], [0], [0])
                continue
            if b != bucket:
                if bucket is not None:
                    yield from close()
                bucket, count, total, parts, known = b, {}, [], {}, None
            if kind == 0:
                text, lengths, seen = unpacked(payload, bytes, np.int32, np.int64)
                own, at = np.empty(len(lengths), np.int32), 0
                for i, (stop, c) in enumerate(zip(np.cumsum(lengths).tolist(), seen.tolist())):
                    k = count.setdefault(text[at:stop], len(count))
                    if k == len(total):
                        total.append(c)
                    else:
                        total[k] += c
                    own[i], at = k, stop
                parts[number] = own
                continue
            if known is None:
                known, total = np.array(total, np.int64), []
                logs = np.log10(known + 0.5)
            local, doc, n = unpacked(payload, np.int32, np.int32, np.int32)
            word = parts.pop(number)[local]
            heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            sums_, seen = np.add.reduceat(logs[word] * n, heads), np.add.reduceat(n * (known[word] > 0), heads)
            yield batch([number], [packed(doc[heads], sums_, seen.astype(np.int32))], [0], [0], [0], [0])
    if bucket is not None:
        yield from close()


def unigram_answers(rows: DataFrame, path: str) -> DataFrame:
    """ANSWERS of the word buckets, and for each block the ids of its texts (payload with tag 1)."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        for block in blocks(batches, 2 * BLOCK_BYTES):
            ids = block.column(0)
            who = packed(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), block.column(1).to_numpy(zero_copy_only=False))
            for row in (*shipped(block, tasks, part + number), (-1, 2, part + number, who)):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int8(), pa.int64(), pa.binary()))], names=["bucket", "kind", "block", "payload"])
            number += 1

    def add(batches):
        return summed(batches, path)

    sent = rows.select("doc_id", "tag", "text").mapInArrow(send, PACKED).repartition(tasks, "bucket", F.when(F.col("bucket") < 0, F.col("block"))).sortWithinPartitions("bucket", "kind", "block")
    return sent.mapInArrow(add, ANSWERS)


def text_sums(answers: DataFrame) -> DataFrame:
    """doc_id, tag, s, known: for each text the sum of log10(count + 0.5) and its known tokens, from the packed sums of its block."""
    tasks = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def close(ids, nulls, tags, s, known) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, mask=nulls), "tag": tags, "s": s, "known": known})

    def run(batches) -> Iterator[pa.RecordBatch]:
        state, of = None, None
        for batch in batches:
            for number, tag, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if number != of:
                    if state:
                        yield close(*state)
                    ids, nulls, tags = unpacked(payload, np.int64, np.bool_, np.int32)  # tag 1 comes first
                    of, state = number, (ids, nulls, tags, np.zeros(len(ids)), np.zeros(len(ids), np.int64))
                    continue
                doc, s, known = unpacked(payload, np.int32, np.float64, np.int32)
                state[3][doc] += s
                state[4][doc] += known
        if state:
            yield close(*state)

    own = answers.where("block IS NOT NULL").select("block", "tag", "payload")
    return own.repartition(tasks, "block").sortWithinPartitions("block", F.desc("tag")).mapInArrow(run, "doc_id long, tag int, s double, known long")


class Classes:
    """The classes of the next subword: the likeliest ids alone, the others in groups of about equal count."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        alone = CLASSES * 3 // 4
        self.of = np.zeros(len(counts), np.int64)
        self.of[order[:alone]] = np.arange(min(alone, len(order)))
        rest = order[alone:]
        share = np.cumsum(counts[rest] + 0.5)
        self.of[rest] = alone + np.minimum((share * (CLASSES - alone) / max(share[-1] if len(share) else 1, 1e-9)).astype(np.int64), CLASSES - alone - 1)
        smooth = counts + 0.5
        mass = np.bincount(self.of, smooth, CLASSES)
        self.inside = np.log(smooth / mass[self.of])
        self.prior = np.log((mass + 1e-9) / mass.sum())
        self.row = np.full(len(counts), 0, np.int64)
        own = INPUTS - CLASSES - 1
        self.row[order[:own]] = 1 + np.arange(min(own, len(order)))
        self.row[order[own:]] = 1 + own + self.of[order[own:]]  # row 0 begins a text


def subwords(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of each text with an end, and where each text begins."""
    codes, distinct, firsts = words_of(texts)
    encode, _ = vocabulary(path)
    ids, many = encode(distinct.to_pylist())
    from_ = np.cumsum(many) - many
    count = many[codes] if len(codes) else np.zeros(0, np.int64)
    each = np.repeat(from_[codes] - (np.cumsum(count) - count), count) + np.arange(count.sum()) if len(codes) else np.zeros(0, np.int64)
    n = sums(count, firsts)
    begins = np.r_[0, np.cumsum(n + 1)]
    out = np.full(int(begins[-1]), end, np.int64)
    keep = np.ones(len(out), bool)
    keep[begins[1:] - 1] = False
    out[keep] = ids[each]
    return out, begins


def batches_of(ids: np.ndarray, begins: np.ndarray, classes: Classes, size: int, seed: int | None = None) -> Iterator[tuple]:
    """Batches of windows: their texts, inputs, which inputs are there, the ids to predict, the classes before them and
    which are scored. seed: of a mixed order of the windows."""
    doc, places, scored = net.windows_of(begins)
    if seed is not None:
        order = np.random.default_rng(seed).permutation(len(doc))
        doc, places, scored = doc[order], places[order], scored[order]
    for at in range(0, len(doc), size):
        part = slice(at, at + size)
        d, place, score = doc[part], places[part], scored[part]
        there = (place >= 0) & (place < np.diff(begins)[d][:, None])
        target = ids[np.where(there, begins[:-1][d][:, None] + place, 0)]
        before = (place > 0) & there
        last = ids[np.where(before, begins[:-1][d][:, None] + place - 1, 0)]
        inputs, previous = np.where(before, classes.row[last], 0), np.where(before, classes.of[last], CLASSES)
        yield d, inputs, there, target, previous, score  # the input of place 0 is the beginning


def shards_of(tokens: float) -> tuple[int, int]:
    """Shards for so many training subwords, and the slots of one, whose texts stay together."""
    shards = max(LEAST_SHARDS, -(-int(tokens) // SHARD_TOKENS))
    return shards, max(1, -(-int(tokens) // (shards * COPY_TOKENS)))


def dealt(train: DataFrame, path: str, end: int, classes: Classes, tokens: float) -> DataFrame:
    """SHARDS, written: the subwords of every training text (packed ids and lengths), dealt out one text after the other;
    and as shard -1 the packed counts of pairs (class before, subword) of each task, by slices of the classes."""
    shards, slots = shards_of(tokens)

    def row(shard: int, slot: int, payload: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([slot], pa.int32()), pa.array([payload], pa.binary())], names=["shard", "slot", "payload"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        number, pairs = TaskContext.get().partitionId(), None
        for block in blocks(batches, BLOCK_BYTES):
            ids, begins = subwords(block.column(0), path, end)
            before = np.r_[CLASSES, classes.of[ids[:-1]]]
            before[begins[:-1]] = CLASSES
            if pairs is None:
                pairs = np.zeros((CLASSES + 1) * (end + 1), np.int64)
            found, n = np.unique(before * (end + 1) + ids, return_counts=True)
            pairs[found] += n
            to, lengths = (np.arange(block.num_rows) + number) % (shards * slots), np.diff(begins)
            for k in np.unique(to).tolist():
                some = to == k
                yield row(k % shards, k // shards, packed(ids[np.repeat(some, lengths)].astype(np.int32), lengths[some].astype(np.int32)))
            number += 1
        if pairs is not None:
            some = np.flatnonzero(pairs)
            part = some // (end + 1) % PAIR_SLICES
            for k in np.unique(part).tolist():
                yield row(-1, k, packed(some[part == k].astype(np.int64), pairs[some[part == k]]))

    spark = train.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    train.select("text").mapInArrow(run, SHARDS).repartition(tasks, "shard", "slot").write.partitionBy("shard", "slot").parquet(folder)
    return spark.read.schema("payload binary, shard int, slot int").parquet(folder)


def pair_counts(shards: DataFrame, end: int) -> np.ndarray:
    """Training counts of each subword (columns) after each class and at the beginning (rows)."""

    def add(batches) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                at, n = unpacked(payload, np.int64, np.int64)
                total = np.zeros((CLASSES + 1) * (end + 1), np.int64) if total is None else total
                total[at] += n
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"payload": pa.array([packed(at.astype(np.int64), total[at])], pa.binary())})

    out = np.zeros((CLASSES + 1) * (end + 1))
    own = shards.where("shard = -1").repartition(PAIR_SLICES, "slot").select("payload")
    for r in own.mapInArrow(add, "payload binary").collect():  # PAIR_SLICES rows at most: at most classes by vocabulary
        at, n = unpacked(r.payload, np.int64, np.int64)
        out[at] += n
    return out.reshape(CLASSES + 1, end + 1)


def inside_given(pairs: np.ndarray, classes: Classes) -> np.ndarray:
    """Log probability of a subword (columns) in its class, given the class before it (rows): the counts of pairs,
    with the corpus share as SHARE_WEIGHT further tokens."""
    out = np.empty(pairs.shape, np.float32)
    share = np.exp(classes.inside) * SHARE_WEIGHT
    for k, n in enumerate(pairs):
        out[k] = np.log((n + share) / (np.bincount(classes.of, n, CLASSES)[classes.of] + SHARE_WEIGHT))
    return out


def trained(shard: DataFrame, classes: Classes, p: net.Parameters, rate: float) -> net.Parameters:
    """One shard: tasks train copies on their texts, which are averaged by the tokens they saw."""
    start = net.to_bytes(p)
    width = -(-len(start) // SLICES)

    def run(batches) -> Iterator[pa.RecordBatch]:
        mine, seen, adam = net.from_bytes(start, p), 0, net.Adam(p, rate)
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                ids, lengths = unpacked(payload, np.int32, np.int32)
                for _, inputs, there, target, _, score in batches_of(ids, np.r_[0, np.cumsum(lengths, dtype=np.int64)], classes, BATCH, len(ids)):
                    adam.update(mine, net.gradients(mine, inputs, there, classes.of[target], score)[1])
                    seen += int(score.sum())
        if seen:
            flat = np.pad(net.to_bytes(mine), (0, width * SLICES - len(start)))
            yield pa.RecordBatch.from_pydict({"slice": np.arange(SLICES, dtype=np.int32), "seen": np.full(SLICES, seen), "w": [x.tobytes() for x in flat.reshape(SLICES, width)]})

    def mean(copies):  # of one slice: a few kilobytes from each task
        seen = copies["seen"].to_numpy()
        weights = np.frombuffer(b"".join(copies["w"].to_pylist()), np.float32).reshape(len(seen), width)
        total = (seen[:, None] / seen.sum() * weights).sum(axis=0).astype(np.float32)
        return pa.table({"slice": copies["slice"][:1].cast(pa.int32()), "w": pa.array([total.tobytes()], pa.binary())})

    copies = shard.select("payload").mapInArrow(run, "slice int, seen long, w binary")
    rows = copies.groupBy("slice").applyInArrow(mean, "slice int, w binary").collect()  # SLICES rows: one model
    if not rows:
        return p
    flat = np.concatenate([np.frombuffer(r.w, np.float32) for r in sorted(rows, key=lambda r: r.slice)])
    return net.from_bytes(flat[: len(start)], p)


def scores(ids: np.ndarray, begins: np.ndarray, classes: Classes, p: net.Parameters, given: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    out = np.zeros(len(begins) - 1)
    for d, inputs, there, target, previous, score in batches_of(ids, begins, classes, 128):
        target, previous, score = (x[:, net.CONTEXT :] for x in (target, previous, score))
        logp = net.log_likelihoods(p, inputs, there, classes.of[target]) + given[previous, target]
        np.add.at(out, d, (logp * score).sum(axis=1))
    return out / np.log(10)


def lm_scores(docs: DataFrame, path: str) -> DataFrame:
    """Scores of each row of docs (doc_id, text); whole texts are scored, every token once.

    path: a vocabulary of ranks, whose subwords the model predicts. Texts whose crc32(doc_id) leaves
    HELD by FOLDS are held out: nothing is learnt from them. Result: doc_id, held_out, n_tokens
    (words and one end), n_known, train_tokens, base_score, score (log10 probabilities of the text).
    A null text has only its end; a null doc_id counts as the empty text for the fold; repeated rows
    give repeated results and count as often as they occur; other columns are not looked at; an
    empty table gives an empty result. With no training text the base gives each token
    probability 1 and the model is untrained. Every training text trains the model over its whole
    length in each of ROUNDS rounds, and is counted; its subwords are written in the shared folder once.
    """
    rows = numbered(docs)
    base = cut_lineage(unigram_answers(rows, path))
    totals = base.where(F.col("tag") == TOTALS).agg(F.sum("n").alias("n"), F.sum("known").alias("v")).first()
    n, v = totals.n or 0, totals.v or 0
    encode, is_byte = vocabulary(path)
    end = len(is_byte)
    counts = np.zeros(end + 1)
    for r in base.where(F.col("tag") == SUBWORDS).groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r.id] = r.n
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    train = rows.where(F.crc32(key.cast("binary")) % FOLDS != HELD)
    classes = Classes(counts)
    p = net.fresh(INPUTS, classes.prior)
    shards, (many, _) = dealt(train, path, end, classes, counts.sum()), shards_of(counts.sum())
    given = inside_given(pair_counts(shards, end), classes)
    for step in range(ROUNDS * many):
        p = trained(shards.where(F.col("shard") == step % many), classes, p, RATE * (1 - step / (ROUNDS * many)))
    flat = net.to_bytes(p)

    def run(batches) -> Iterator[pa.RecordBatch]:
        mine = net.from_bytes(flat, p)
        for block in blocks(batches, BLOCK_BYTES):
            ids, begins = subwords(block.column(2), path, end)
            bytes_, at = raw_bytes(block.column(2))
            words = np.diff(word_ranges(bytes_, at)[2])
            yield pa.RecordBatch.from_pydict({"doc_id": block.column(0), "tag": block.column(1), "held_out": fold(block.column(0).to_pylist()) == HELD, "n_tokens": words + 1, "score": scores(ids, begins, classes, mine, given)})

    scored = rows.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag int, held_out boolean, n_tokens long, score double")
    own = text_sums(base).groupBy(F.col("doc_id").alias("d"), F.col("tag").alias("t")).agg(F.max("s").alias("s"), F.max("known").alias("n_known"))  # rows alike have like sums
    level = float(np.log10(n + 0.5 * (v + 1)))
    joined = scored.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")))
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("s") - F.col("n_tokens") * F.lit(level)).alias("base_score"), "score")
