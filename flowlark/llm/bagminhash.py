"""Near-duplicate texts by BagMinHash signatures of their word shingles, counted with repeats.

A shingle that occurs w times has weight w. Weights are cut into the intervals [0, 1), [1, 2),
[2, 4), [4, 8), ... Each interval of each shingle has a Poisson process of points in time, as
wide as the interval, whose points carry a register and a place in the interval; a point
counts for a text if its place lies below the shingle's weight there. A register keeps its
earliest point, so two texts agree in a register with the probability of their weighted
Jaccard similarity. No point later than the latest register matters, so processes are
followed only up to a bound, which is raised for the few texts whose registers are not full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlark.llm.components import components, release
from flowlark.llm.text import BLOCK_BYTES, blocks, coded, dense, freed, mixed, owners, pieces, raw_bytes, sums, word_hashes, word_ranges
from flowlark.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Pairs whose share of equal registers lies so far (over four standard deviations) below the threshold are not compared.
SLACK = 0.15
#: Most bytes of text and most texts of a block of a bucket's members; two blocks are one task's work.
BLOCK_TEXT, BLOCK_ROWS = 16 << 20, 4096
#: Strays whose signatures are compared with a block at once.
AT_ONCE = 32


def shingles(codes: np.ndarray, firsts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every run of SHINGLE words; a shorter text with words is one shingle."""
    n = np.diff(firsts)
    doc = owners(firsts)
    h = hashes[codes]
    with np.errstate(over="ignore"):
        total = np.zeros(len(h), np.uint64)
        for k in range(SHINGLE):
            ahead = np.zeros(len(h), np.uint64)
            ahead[: len(h) - k] = h[k:]
            inside = np.arange(len(h)) + k < firsts[1:][doc] if len(h) else np.zeros(0, bool)
            total = mixed(total + np.where(inside, ahead, np.uint64(0)), k)
    starts = np.arange(len(h)) - firsts[:-1][doc] if len(h) else np.zeros(0, np.int64)
    keep = starts < np.maximum(n - SHINGLE + 1, 1)[doc] if len(h) else np.zeros(0, bool)
    return doc[keep], total[keep]


def weighted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, shingle) pairs and how often each occurs."""
    if not len(doc):
        return doc, hashes, doc
    distinct, code = np.unique(hashes, return_inverse=True)
    keys, count = np.unique(doc * np.int64(len(distinct)) + code, return_counts=True)
    return keys // len(distinct), distinct[keys % len(distinct)], count


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """One row of 16-bit register values for each of n texts; of a text without shingles they are 0."""
    best = np.full(n * registers, np.inf)
    total = np.bincount(doc, weight, n) if len(doc) else np.zeros(n)
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1 if len(doc) else doc
    entry = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(entry)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    stream = mixed(shingle[entry] + mixed(level.astype(np.uint64), 11), 12) if len(entry) else np.zeros(0, np.uint64)
    owner, top, active = doc[entry], weight[entry], total > 0
    bound = np.where(active, (np.log(registers) + 6) / np.maximum(total, 1), 0)
    while active.any():
        at = np.flatnonzero(active[owner])
        time, step = np.zeros(len(at)), 0
        while len(at):
            draw = mixed(stream[at] + np.uint64(step), 13)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / (width[at] * registers)
            soon = time < bound[owner[at]]
            at, time = at[soon], time[soon]
            more = mixed(stream[at] + np.uint64(step), 14)
            place = low[at] + (more >> np.uint64(32)).astype(np.int64) % width[at]
            counts = place < top[at]
            register = (more & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers
            np.minimum.at(best, (owner[at] * registers + register)[counts], time[counts])
            step += 1
        filled = np.isfinite(best.reshape(n, registers)).all(axis=1)
        active &= ~filled
        bound = bound * 2
    values = (mixed(best.view(np.uint64), 15) & np.uint64(0xFFFF)).astype(np.uint16)
    return np.where((total > 0)[:, None], values.reshape(n, registers), 0).astype(np.uint16)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the words), signature and bytes of each row; key and signature are null for a text without words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES // 2):
            bytes_, begins = raw_bytes(block.column(1))
            starts, ends, firsts = word_ranges(bytes_, begins)
            words = pieces(bytes_, starts, ends, pa.binary())
            codes, distinct = coded(words)
            doc, shingle = shingles(codes, firsts, word_hashes(distinct))
            made = signatures(*weighted(doc, shingle), len(begins) - 1)
            texts, at = words.to_pylist(), firsts.tolist()
            some = np.diff(firsts) > 0
            keys = [hashlib.md5(b" ".join(texts[a:b])).digest() if b > a else None for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": block.column(0), "key": pa.array(keys, pa.binary()), "signature": pa.array([made[i].tobytes() if ok else None for i, ok in enumerate(some.tolist())], pa.binary()), "bytes": np.diff(begins)})

    return docs.mapInArrow(freed(run), "doc_id long, key binary, signature binary, bytes long")


def band_buckets(made: np.ndarray) -> np.ndarray:
    """The bucket of each band of each signature."""
    band = np.ascontiguousarray(made.reshape(-1, BANDS, ROWS)).view(np.uint64)[:, :, 0]
    return mixed(band + mixed(np.arange(BANDS, dtype=np.uint64), 21)[None, :], 22).view(np.int64)


def bucketed(contents: DataFrame) -> DataFrame:
    """(node, bucket) for each band of each signature."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = band_buckets(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16))
            yield pa.RecordBatch.from_pydict({"node": np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS), "bucket": bucket.ravel()})

    return contents.select("node", "signature").mapInArrow(freed(run), "node long, bucket long")


def alike(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """Pairs (u, v) whose signatures agree in enough registers to be worth comparing."""
    left = contents.select(F.col("node").alias("u"), F.col("signature").alias("a"))
    right = contents.select(F.col("node").alias("v"), F.col("signature").alias("b"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            near = (a == b).mean(axis=1) >= SIMILARITY - SLACK
            yield pa.RecordBatch.from_pydict({c: batch.column(batch.schema.get_field_index(c)).filter(pa.array(near)) for c in ("u", "v")})

    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(freed(run), "u long, v long")


def overlaps(block: pa.RecordBatch) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in columns a and b, from exact shingle counts."""
    rows = block.num_rows
    both = pa.concat_arrays([block.column(block.schema.get_field_index(c)) for c in ("a", "b")])
    bytes_, begins = raw_bytes(both)
    starts, ends, firsts = word_ranges(bytes_, begins)
    codes, _ = coded(pieces(bytes_, starts, ends, pa.binary()))
    n = np.diff(firsts)
    size = int(codes.max()) + 2 if len(codes) else 2
    doc = owners(firsts)
    gram = np.zeros(len(codes), np.int64)
    for k in range(SHINGLE):
        ahead = np.zeros(len(codes), np.int64)
        ahead[: len(codes) - k] = codes[k:] + 1
        ahead[np.arange(len(codes)) + k >= firsts[1:][doc]] = 0
        gram = dense(gram * size + ahead)
    keep = np.arange(len(codes)) - firsts[:-1][doc] < np.maximum(n - SHINGLE + 1, 1)[doc]
    doc, gram = doc[keep], gram[keep]
    width = int(gram.max()) + 1 if len(gram) else 1
    keys, place = np.unique((doc % rows) * width + gram, return_inverse=True)
    a, b = (np.bincount(place[side], minlength=len(keys)) for side in (doc < rows, doc >= rows))
    pair = keys // width
    least, most = (np.bincount(pair, f(a, b), rows) for f in (np.minimum, np.maximum))
    return least / np.maximum(most, 1)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts have at least this similarity."""
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES // 4, "a"):
            near = pa.array(overlaps(block) >= similarity - 1e-12)
            yield pa.RecordBatch.from_pydict({c: block.column(block.schema.get_field_index(c)).filter(near) for c in ("u", "v")})

    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(freed(run), "u long, v long")


def stars(members: DataFrame, turn: int) -> DataFrame:
    """Each node of a bucket with the bucket's centre. members: node, bucket, group; nodes of the centre's own group
    are left out. In turn 0 buckets with the same nodes have the same centre, so that copies are compared
    with few others; later each bucket has its own, so that what is still apart meets many."""
    salt = [F.lit(turn)] if turn == 0 else [F.lit(turn), F.col("bucket")]
    order = F.struct(F.xxhash64("node", *salt).alias("o"), "node", "group")
    centre = members.groupBy("bucket").agg(F.min(order).alias("c"))
    pairs = members.join(centre, "bucket").where("`group` <> c.`group`")
    return pairs.select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v")).distinct()


def dealt(members: DataFrame, contents: DataFrame) -> DataFrame:
    """The members of each bucket with more than one group, as work of tasks: each block of its strays (members
    outside its largest group) meets each part of all its members.

    Result: bucket, block, part, node, group, stray, as_stray and as_member (whether the row is in the task as one
    of the block, of the part, or both). The number of blocks and parts follows from the measured size of the
    bucket, so a task holds two blocks however large a bucket is.
    """
    load = F.greatest(F.col("bytes") / BLOCK_TEXT, F.lit(1 / BLOCK_ROWS))
    held = members.join(contents.select("node", load.alias("load")), "node")
    groups = held.groupBy("bucket", "group").agg(F.count("*").alias("n"), F.sum("load").alias("load"))
    most = F.max(F.struct("n", "group", "load"))
    sizes = groups.groupBy("bucket").agg(most.alias("main"), F.sum("load").alias("load"), F.count("*").alias("groups")).where("groups > 1")
    sizes = sizes.select("bucket", F.col("main.group").alias("main"), F.ceil("load").cast("int").alias("parts"), F.greatest(F.ceil(F.col("load") - F.col("main.load")), F.lit(1)).cast("int").alias("blocks"))
    marked = held.join(sizes, "bucket").withColumn("stray", F.col("group") != F.col("main"))
    marked = marked.withColumns({"own_part": F.expr("pmod(xxhash64(node), parts)").cast("int"), "own_block": F.expr("pmod(xxhash64(node, 1), blocks)").cast("int")})
    as_member = F.expr("transform(sequence(0, blocks - 1), b -> struct(b AS block, own_part AS part))")
    as_stray = F.expr("transform(sequence(0, parts - 1), p -> struct(own_block AS block, p AS part))")
    works = marked.withColumn("at", F.explode(F.when(F.col("stray"), F.array_union(as_member, as_stray)).otherwise(as_member)))
    return works.select("bucket", "at.block", "at.part", "node", "group", "stray", (F.col("stray") & (F.col("own_block") == F.col("at.block"))).alias("as_stray"), (F.col("own_part") == F.col("at.part")).alias("as_member"))


def in_tasks(works: DataFrame, solve, schema: str) -> DataFrame:
    """solve(rows) for the rows of each (bucket, block, part); it gives a record batch or None."""
    tasks = int(works.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = works.repartition(tasks, "bucket", "block", "part").sortWithinPartitions("bucket", "block", "part")

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, waiting = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            edges = np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(axis=0), True])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (here := tuple(where[:, lo].tolist())) != at:
                    if waiting and (made := solve(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])) is not None:
                        yield made
                    at, waiting = here, []
                waiting.append(batch.slice(lo, hi - lo))
        if waiting and (made := solve(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])) is not None:
            yield made

    return rows.mapInArrow(freed(run), schema)


def column(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def near_pairs(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (stray, member) of one task in different groups whose signatures are worth comparing further, as places
    in `rows`. A pair that shares several buckets is taken in that of its first common band only."""
    node, group = column(rows, "node"), column(rows, "group")
    stray, as_stray, as_member = (column(rows, c).astype(bool) for c in ("stray", "as_stray", "as_member"))
    made = np.frombuffer(b"".join(rows.column(rows.schema.get_field_index("signature")).to_pylist()), np.uint16).reshape(-1, REGISTERS)
    bucket = rows.column(0)[0].as_py()
    own, others = np.flatnonzero(as_stray), np.flatnonzero(as_member)
    found = []
    for k in range(0, len(own), AT_ONCE):
        some = own[k : k + AT_ONCE]
        may = (group[some][:, None] != group[others][None, :]) & (~stray[others][None, :] | (node[others][None, :] > node[some][:, None]))
        i, j = np.nonzero(may)
        equal = made[some[i]] == made[others[j]]
        near = np.count_nonzero(equal, axis=1) >= (SIMILARITY - SLACK) * REGISTERS
        i, j, equal = i[near], j[near], equal[near]
        if len(i):
            band = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            first = band_buckets(made[some])[i, band] == bucket
            found.append((some[i[first]], others[j[first]]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def joining_links(rows: pa.RecordBatch, similarity: float) -> pa.RecordBatch | None:
    """Of the near pairs of one task those that are similar enough and join two groups not yet joined in the task:
    fewer than it has groups. Similarities are exact counts of 64-bit shingle hashes."""
    own, others = near_pairs(rows)
    if not len(own):
        return None
    node, group = column(rows, "node"), column(rows, "group")
    bytes_, begins = raw_bytes(rows.column(rows.schema.get_field_index("text")))
    starts, ends, firsts = word_ranges(bytes_, begins)
    codes, distinct = coded(pieces(bytes_, starts, ends, pa.binary()))
    doc, shingle, count = weighted(*shingles(codes, firsts, word_hashes(distinct)))
    _, ids = np.unique(shingle, return_inverse=True)
    edges = np.searchsorted(doc, np.arange(len(begins)))
    total = sums(count, edges)
    parent: dict[int, int] = {}

    def root(g: int) -> int:
        while (up := parent.get(g, g)) != g:
            parent[g] = g = parent.get(up, up)
        return g

    here = np.zeros(int(ids.max()) + 1, np.int64)
    u, v = [], []
    order = np.argsort(own, kind="stable")
    own, others = own[order], others[order]
    turns = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
    for lo, hi in zip(turns[:-1].tolist(), turns[1:].tolist()):
        a, b = own[lo], others[lo:hi]
        # Totals too far apart cannot be similar enough.
        b = b[np.minimum(total[a], total[b]) >= (similarity - 1e-12) * np.maximum(total[a], total[b])]
        mine = slice(edges[a], edges[a + 1])
        here[ids[mine]] = count[mine]
        for k in range(0, len(b), 256):
            part = b[k : k + 256]
            sizes = edges[part + 1] - edges[part]
            at = np.repeat(edges[part] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
            both = sums(np.minimum(here[ids[at]], count[at]), np.r_[0, np.cumsum(sizes)])
            for x in part[both >= (similarity - 1e-12) * (total[a] + total[part] - both)].tolist():
                g, h = root(int(group[a])), root(int(group[x]))
                if g != h:
                    parent[max(g, h)] = min(g, h)
                    u.append(int(node[a]))
                    v.append(int(node[x]))
        here[ids[mine]] = 0
    return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def crossing(members: DataFrame, contents: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that join groups of a bucket: every stray against every member of another group.

    First signatures alone meet, and only members with a pair worth comparing stay; then these meet with
    their texts and are compared in the task. No pair leaves a task but those that join two groups.
    """
    columns = ["bucket", "block", "part", "node", "group", "stray", "as_stray", "as_member"]

    def promising(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        at = np.unique(np.concatenate(near_pairs(rows)))
        return rows.select(columns).take(pa.array(at)) if len(at) else None

    signature = contents.select("node", "signature")
    schema = "bucket long, block int, part int, node long, `group` long, stray boolean, as_stray boolean, as_member boolean"
    left = in_tasks(dealt(members, contents).join(signature, "node").select(*columns, "signature"), promising, schema)
    whole = left.join(signature.join(texts, "node"), "node").select(*columns, "signature", "text")
    return in_tasks(whole, lambda rows: joining_links(rows, similarity), "u long, v long")


def regrouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of buckets that still hold more than one group under these links."""
    of = components(links).select("node", F.col("component").alias("c"))
    now = members.join(of, "node", "left").select("node", "bucket", F.coalesce("c", "node").alias("group"))
    open_ = now.groupBy("bucket").agg(F.min("group").alias("a"), F.max("group").alias("z")).where("a <> z").select("bucket")
    return cut_lineage(now.join(open_, "bucket", "left_semi"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, turns: int = 2) -> DataFrame:
    """doc_id and class_id of each row of docs (doc_id, text) with a doc_id; a class is named by its least doc_id.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles is at least
    `similarity`; classes are what links connect. Texts with the same words are one node and are not
    compared. Candidates share a band of four registers out of 32, and must agree in
    enough registers; a link of similarity 0.8 is missed with a probability of about 1e-5. In a bucket, first `turns` different centres are compared with
    all others, then every pair that is still in different groups, block by block inside tasks: no link between
    groups is passed over, members of a group that is already connected need no more comparing, and no
    more links come out of a task than join its groups. Processes of the levels of a weight are independent of each
    other; none is split further.

    Rows with a null doc_id are left out. A text without words is alone in its class. Rows that
    repeat a doc_id are in one class. Other columns are not looked at; an empty table gives an empty
    result.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = cut_lineage(signed(rows))
    contents = cut_lineage(marked.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.max("bytes").alias("bytes")))
    shared = bucketed(contents)
    crowded = shared.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = cut_lineage(shared.join(crowded, "bucket", "left_semi").distinct().withColumn("group", F.col("node")))
    # A node stands for the least doc_id of its words; which of a repeated doc_id's texts it is, its key tells.
    wanted = members.select(F.col("node").alias("doc_id")).distinct().join(contents.select(F.col("node").alias("doc_id"), "key"), "doc_id")
    words = F.unhex(F.md5(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).cast("binary")))
    texts = rows.join(wanted.hint("shuffle_hash"), "doc_id").where(words == F.col("key")).groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    texts = cut_lineage(texts.select(F.col("doc_id").alias("node"), "text"))
    release(docs.sparkSession)
    links = docs.sparkSession.createDataFrame([], "u long, v long")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(turns):
        found = verified(alike(stars(members, turn), contents), texts, similarity)
        links = cut_lineage(links.unionByName(found).coalesce(tasks))
        release(docs.sparkSession)
        members = regrouped(members, links)
    links = cut_lineage(links.unionByName(crossing(members, contents, texts, similarity)).coalesce(tasks))
    rows_of = marked.join(contents.select("key", "node"), "key", "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"))
    again = rows_of.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v")
    every = rows_of.join(again.select("doc_id", "u"), "doc_id").select("u", F.col("node").alias("v"))
    classes = components(links.unionByName(every))
    out = rows_of.join(classes, "node", "left").select("doc_id", F.coalesce("component", "node").alias("class_id"))
    return out
