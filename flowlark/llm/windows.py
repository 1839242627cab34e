"""Windows of a text that also stand in a document with a smaller id.

Consecutive windows that share a minimiser travel as one packed string to the bucket of
that minimiser, so equal windows meet whatever document they are in. A minimiser that only
one document has cannot hold a repeated window; hashes of the minimisers are counted first,
and only strings of those that two documents have travel.

A block of documents ships each different hash or string once, with the least document id
that holds it; who else holds it follows in rows that are read after all hashes or strings of
the bucket are known. What a task keeps is therefore bounded by the different strings of one
bucket and block, however often one occurs.

Each block has a row for each bucket. So that a larger table does not have rows by the square of its size, blocks
are shipped together and buckets are joined, both by the root of its size; a joined bucket is solved part by part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowlark.llm.text import BLOCK_BYTES, IN_CACHE, blocks, freed, owners

#: Bytes of packed strings that a part of a bucket should hold, bytes of text up to which a bucket has one part, and its most parts.
BUCKET_BYTES, ROOT_BYTES, MOST_PARTS = 4 << 20, 1 << 30, 8
#: Bytes of payloads that go to the JVM together.
SENT_BYTES = 1 << 20
ZIP, UNZIP = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
PACKED = "bucket int, kind byte, block long, payload binary"
RUNS = "doc_id long, tag int, start int, n int"


def numbered(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, tag, text and the columns to keep: tag tells texts apart that repeat a doc_id, or have none (0 elsewhere)."""
    keep = keep or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    repeats = rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if repeats.isEmpty():
        return rows.select("doc_id", F.lit(0).alias("tag"), "text", *keep)
    often = repeats.select(F.col("doc_id").alias("again"), F.lit(True).alias("often"))
    marked = rows.join(often, rows["doc_id"].eqNullSafe(often["again"]), "left")
    single = marked.where("often IS NULL").select("doc_id", F.lit(0).alias("tag"), "text", *keep)
    # Rows alike in both columns have the same fate and the same tag. A tag is a hash of the text, so no
    # repeated id needs its texts in one place; texts of one id that agree in it are told apart by order.
    several = marked.where("often").withColumn("h", F.abs(F.xxhash64("text") % (1 << 30)).cast("int"))
    order = Window.partitionBy("doc_id", "h").orderBy(F.col("text").asc_nulls_first())
    tags = several.select("doc_id", "h", "text").distinct().select(F.col("doc_id").alias("d"), F.col("text").alias("t"), (F.col("h") + F.row_number().over(order)).alias("tag"))
    several = several.join(tags, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text").eqNullSafe(F.col("t")))
    return single.unionByName(several.select("doc_id", "tag", "text", *keep))


@dataclass
class Cut:
    """Packed strings of some texts: hash and place of the minimiser of each, the text it is from, its first
    window there, and how to make the strings themselves."""

    hashes: np.ndarray
    marks: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    strings: Callable[[np.ndarray], list[bytes]]


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """The arrays in one compressed piece; numbers byte by byte, as their high bytes are much alike."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return ZIP.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts))


def unpacked(payload: bytes, *kinds) -> list:
    raw = UNZIP.decompress(payload)
    ends = (np.cumsum(np.frombuffer(raw, np.int64, len(kinds))) + 8 * len(kinds)).tolist()
    parts = zip(kinds, [8 * len(kinds), *ends[:-1]], ends)
    return [raw[a:b] if k is bytes else np.ascontiguousarray(np.frombuffer(raw[a:b], np.uint8).reshape(np.dtype(k).itemsize, -1).T).view(k).ravel() for k, a, b in parts]


def minimiser_runs(order: np.ndarray, windows: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same minimiser: their first windows, their lengths, the minimiser's place.

    order: a hash for each place; windows: whether a window may start there; a window sees `reach` places.
    The least hash wins, the leftmost of equal ones.
    """
    n = len(windows)
    if not windows.any():
        return (np.zeros(0, np.int64),) * 3
    places = np.uint64(max(1, int(len(order)).bit_length()))
    place = np.zeros(n, np.int64)
    for at in range(0, min(n, len(order) - reach + 1), IN_CACHE):
        part = order[at : at + IN_CACHE + reach - 1]
        low = (part >> places << places) | np.arange(at, at + len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= reach:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        rest = reach - size
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        own = place[at : at + len(low)]
        own[:] = low[: len(own)] & ((np.uint64(1) << places) - np.uint64(1))
    opens = windows.copy()
    opens[1:] &= ~(windows[:-1] & (place[1:] == place[:-1]))
    starts = np.flatnonzero(opens)
    closes = windows.copy()
    closes[:-1] &= ~(windows[1:] & (place[1:] == place[:-1]))
    return starts, np.flatnonzero(closes) + 1 - starts, place[starts]


def sightings(group: Iterable[pa.RecordBatch], cut: Callable, buckets: int, number: int) -> Iterator[tuple]:
    """For each bucket the different minimisers of some blocks with the least and greatest document, then who has them."""
    found = []
    for block in group:
        ids, tags = (block.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        own = cut(block.column(2))
        found.append((own.hashes, ids[own.doc], tags[own.doc], own.start))
    hashes, *rest = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(hashes, kind="stable")
    h, (ids, tags, start) = hashes[order], (c[order] for c in rest)
    if not len(h):
        return
    heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    many = np.diff(np.r_[heads, len(h)])
    least, most = (f.reduceat(ids, heads) for f in (np.minimum, np.maximum))
    bucket, short = (h[heads] % np.uint64(buckets)).astype(np.int64), (h[heads] // np.uint64(buckets)).astype(np.uint32)
    by = np.lexsort((least, bucket))
    stops = np.searchsorted(bucket[by], np.unique(bucket), "right")
    for mine in np.split(by, stops[:-1]):
        yield int(bucket[mine[0]]), 0, number, packed(short[mine], np.diff(least[mine], prepend=0), most[mine] - least[mine])
        own = np.repeat(heads[mine] - (np.cumsum(many[mine]) - many[mine]), many[mine]) + np.arange(many[mine].sum())
        yield int(bucket[mine[0]]), 1, number, packed(many[mine].astype(np.int32), ids[own] - np.repeat(least[mine], many[mine]), tags[own].astype(np.int32), start[own].astype(np.int32))


class Sightings:
    """The minimisers of a bucket, and which of them two documents have."""

    def __init__(self, bucket: int):
        self.bucket, self.blocks, self.shared = bucket, {}, None

    def take(self, number: int, payload: bytes) -> None:
        short, least, more = unpacked(payload, np.uint32, np.int64, np.int64)
        least = np.cumsum(least)
        self.blocks[number] = short, least, least + more

    def answer(self, number: int, payload: bytes) -> pa.RecordBatch | None:
        if self.shared is None:
            short, least, most = (np.concatenate(x) for x in zip(*self.blocks.values()))
            _, group = np.unique(short, return_inverse=True)
            low, high = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, group, least)
            np.maximum.at(high, group, most)
            stops = np.cumsum([len(x[0]) for x in self.blocks.values()])
            self.shared = dict(zip(self.blocks, np.split((low < high)[group], stops[:-1])))
        many, more, tags, start = unpacked(payload, np.int32, np.int64, np.int32, np.int32)
        least, on = np.repeat(self.blocks[number][1], many), np.repeat(self.shared[number], many)
        if not on.any():
            return None
        return pa.RecordBatch.from_pydict({"doc_id": (least + more)[on], "tag": tags[on], "start": start[on]})


def shipped(group: Iterable[pa.RecordBatch], cut: Callable, buckets: int, number: int, parts: int = 1) -> Iterator[tuple]:
    """The rows of some blocks: for each bucket its different strings, part by part, and after them who holds them.
    Column `wanted` has the first windows of the strings to ship."""
    code: dict[bytes, int] = {}
    found = []
    for block in group:
        some = block.filter(block.column(block.schema.get_field_index("wanted")).is_valid())
        ids, tags = (some.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        own = cut(some.column(2))
        wanted = some.column(some.schema.get_field_index("wanted"))
        many = wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(own.start.max()) + 1 if len(own.start) else 1
        listed = np.repeat(np.arange(len(many)), many) * width + wanted.flatten().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.isin(own.doc * width + own.start, listed))
        which = np.fromiter((code.setdefault(s, len(code)) for s in own.strings(at)), np.int64, len(at))
        found.append((which, own.marks[at], own.hashes[at], ids[own.doc[at]], tags[own.doc[at]], own.start[at]))
    if not code:
        return
    which, marks, hashes, ids, tags, start = (np.concatenate(c) for c in zip(*found))
    first = np.unique(which, return_index=True)[1]
    distinct = list(code)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    part = (hashes[first] % np.uint64(buckets * parts)).astype(np.int64)  # part // parts is the bucket
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    held = np.argsort(place[which], kind="stable")
    here = np.unique(part // parts)
    edges = np.searchsorted(part[order], np.stack([here, here + 1]) * parts)
    for b, lo, hi, begin, end in zip(here.tolist(), *edges.tolist(), *np.searchsorted(place[which][held], edges).tolist()):
        mine, own = order[lo:hi], held[begin:end]
        texts = [distinct[i] for i in mine.tolist()]
        lengths = np.fromiter(map(len, texts), np.int32, len(texts))
        sizes = np.bincount(part[mine] - b * parts, minlength=parts).astype(np.int32)
        yield b, 0, number, packed(b"".join(texts), lengths, marks[first[mine]], least[mine], sizes)
        yield b, 1, number, packed((place[which[own]] - lo).astype(np.int32), ids[own], tags[own].astype(np.int32), start[own].astype(np.int32))


def in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow batches of PACKED."""
    kinds = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("block", pa.int64()), ("payload", pa.binary())])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= SENT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], schema=kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], schema=kinds)


def met(rows: Iterator[pa.RecordBatch], bucket_of: Callable) -> Iterator[pa.RecordBatch]:
    """What the buckets answer, from their sorted rows: first all that is to be known, then who asks."""
    state = None
    for batch in rows:
        columns = [c.to_numpy(zero_copy_only=False) if i < 3 else c for i, c in enumerate(batch.columns)]
        for bucket, kind, number, payload in zip(*columns[:3], columns[3]):
            if state is None or state.bucket != bucket:
                state = bucket_of(bucket)
            if kind == 0:
                state.take(number, payload.as_py())
            elif (out := state.answer(number, payload.as_py())) is not None:
                yield out


class Bucket:
    """The different strings of a bucket, and for each of their windows the least document."""

    def __init__(self, bucket: int, least_documents: Callable):
        self.bucket, self.least_documents = bucket, least_documents
        self.code: dict[bytes, int] = {}
        self.least: list[int] = []
        self.marks: list[int] = []
        self.part: list[int] = []
        self.parts: dict[int, np.ndarray] = {}
        self.solved = None

    def take(self, number: int, payload: bytes) -> None:
        text, lengths, marks, least, sizes = unpacked(payload, bytes, np.int32, np.int32, np.int64, np.int32)
        stops, part = np.cumsum(lengths).tolist(), owners(np.r_[0, np.cumsum(sizes)]).tolist()
        own, code, at = np.empty(len(stops), np.int32), self.code, 0
        for i, (stop, mark, doc) in enumerate(zip(stops, marks.tolist(), least.tolist())):
            k = code.setdefault(text[at:stop], len(code))
            if k == len(self.least):
                self.least.append(doc)
                self.marks.append(mark)
                self.part.append(part[i])
            elif doc < self.least[k]:
                self.least[k] = doc
            own[i], at = k, stop
        self.parts[number] = own

    def solution(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window of each string the least document, the first window of each string, and the strings' places there."""
        strings, marks, least, part = list(self.code), np.array(self.marks), np.array(self.least), np.array(self.part)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        values, firsts, at = [], [np.zeros(1, np.int64)], 0
        for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):  # equal windows are in one part
            v, f = self.least_documents([strings[i] for i in mine.tolist()], marks[mine], least[mine])
            values.append(v)
            firsts.append(f[1:] + at)
            at += f[-1]
        return np.concatenate(values), np.concatenate(firsts), place

    def answer(self, number: int, payload: bytes) -> pa.RecordBatch | None:
        if self.solved is None:
            values, firsts, place = self.solution()
            low, high = (f.reduceat(values, firsts[:-1]) for f in (np.minimum, np.maximum))
            self.code = {}
            self.solved = values, firsts, low, high, place
        values, firsts, low, high, place = self.solved
        local, ids, tags, start = unpacked(payload, np.int32, np.int64, np.int32, np.int32)
        which = place[self.parts.pop(number)[local]]
        some = np.flatnonzero(low[which] < ids)
        if not len(some):
            return None
        which, ids, tags, start = which[some], ids[some], tags[some], start[some]
        whole = high[which] < ids
        n = np.diff(firsts)[which]
        parts = [(ids[whole], tags[whole], start[whole], n[whole])]
        rest = np.flatnonzero(~whole)
        if len(rest):
            owner = np.repeat(rest, n[rest])
            at = np.arange(len(owner)) - np.repeat(np.cumsum(n[rest]) - n[rest], n[rest])
            hit = values[firsts[which[owner]] + at] < ids[owner]
            begin = hit & ~(np.r_[False, hit[:-1]] & (at > 0))
            end = hit & ~(np.r_[hit[1:], False] & np.r_[at[1:] > 0, False])
            b, e = np.flatnonzero(begin), np.flatnonzero(end)
            parts.append((ids[owner[b]], tags[owner[b]], start[owner[b]] + at[b], e - b + 1))
        ids, tags, start, n = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_pydict({"doc_id": ids.astype(np.int64), "tag": tags.astype(np.int32), "start": start.astype(np.int32), "n": n.astype(np.int32)})


def exchanged(rows: DataFrame, send: Callable, bucket_of: Callable, buckets: int, block_bytes: int, schema: str, together: int = 1) -> DataFrame:
    """Rows that `send` makes of so many blocks together, brought together by bucket and answered."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def out(batches):
        part, given = TaskContext.get().partitionId() << 32, blocks(batches, block_bytes)
        for number, first in enumerate(given):
            yield from in_batches(send(itertools.chain([first], itertools.islice(given, together - 1)), buckets, part + number))

    def back(batches):
        return met(batches, bucket_of)

    return rows.mapInArrow(freed(out), PACKED).repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind", "block").mapInArrow(freed(back), schema)


def repeated_runs(rows: DataFrame, cut: Callable, least_documents: Callable, expansion: float, block_bytes: int = 2 * BLOCK_BYTES) -> DataFrame:
    """doc_id, tag, start, n: windows start ... start + n - 1 of a row also start in a smaller document.

    rows: as `numbered` gives them; rows with a null doc_id take no part. cut: the Cut of a text
    column; least_documents: for each window of the different strings the least document.
    expansion: bytes of packed strings per byte of text; block_bytes: bytes of text cut at a time.
    """
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(size)
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * expansion / (parts * BUCKET_BYTES)))
    known = rows.where("doc_id IS NOT NULL").select("doc_id", "tag", "text")
    seen = exchanged(known, lambda b, n, k: sightings(b, cut, n, k), Sightings, max(1, buckets // 4), block_bytes, "doc_id long, tag int, start int", parts)
    wanted = seen.groupBy("doc_id", "tag").agg(F.collect_list("start").alias("wanted"))
    # The same join, on the same side, as in with_runs: Spark shuffles the texts once for both.
    asked = with_lists(rows, wanted).select("doc_id", "tag", "text", "wanted")
    return exchanged(asked, lambda b, n, k: shipped(b, cut, n, k, parts), lambda b: Bucket(b, least_documents), buckets, block_bytes, RUNS, parts)


def parts_for(size: int) -> int:
    """Parts of a bucket, and blocks shipped together, for so many bytes of text."""
    return min(MOST_PARTS, max(1, math.ceil(math.sqrt(size / ROOT_BYTES))))


def with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Every row with the lists of its doc_id and tag, or nulls."""
    lists = lists.withColumnRenamed("doc_id", "d").withColumnRenamed("tag", "t")
    return rows.join(lists.hint("shuffle_hash"), (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t")), "left").drop("d", "t")


def with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Every row with the arrays of its runs; one row for each row given."""
    lists = runs.select("doc_id", "tag", F.struct("start", "n").alias("run")).groupBy("doc_id", "tag").agg(F.collect_list("run").alias("runs"))
    return with_lists(rows, lists.select("doc_id", "tag", F.col("runs.start").alias("starts"), F.col("runs.n").alias("lengths"))).drop("tag")


def covered(block: pa.RecordBatch, firsts: np.ndarray, reach: int) -> np.ndarray:
    """Which elements of the texts lie in a window of the runs; firsts: the first element of each text."""
    names = block.schema.names
    starts, lengths = (block.column(names.index(c)) for c in ("starts", "lengths"))
    change = np.zeros(int(firsts[-1]) + 1, np.int64)
    if len(starts) and starts.null_count < len(starts):
        many = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.repeat(firsts[:-1], many) + starts.flatten().to_numpy(zero_copy_only=False)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + lengths.flatten().to_numpy(zero_copy_only=False) + reach - 1, -1)
    return np.cumsum(change[:-1]) > 0
