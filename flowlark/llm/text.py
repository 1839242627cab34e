"""Whole texts of an Arrow batch as vectors of bytes, words and word codes.

A batch is cut into blocks of whole rows, so that what a task holds is bounded by a block
(or by one row, where a single text is larger). Nothing is cut inside a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
#: Most bytes of an Arrow batch on its way to a worker: it is held on both sides at once.
BATCH_BYTES = 16 << 20
#: Numbers that one step of a longer computation takes at a time, so that they stay in the processor's cache.
IN_CACHE = 1 << 14
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def small_batches(spark) -> None:
    """Lowers the session's limit of bytes in an Arrow batch, where it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = "".join(c for c in spark.conf.get(name) if c.isdigit() or c == "-")
    if not 0 < int(digits) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def blocks(batches, limit: int = BLOCK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with up to `limit` bytes of text each; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        batch = batch.set_column(at, column, pc.fill_null(batch.column(at).cast(pa.string()), ""))
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def let_go(*caches: dict) -> None:
    """Empties what a task has loaded and gives the memory back, as an idle worker lives on beside the next stage."""
    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freed(run):
    """`run` over the batches of a task, after which the worker gives its memory back."""

    def call(batches):
        try:
            yield from run(batches)
        finally:
            let_go()

    return call


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one vector, and where each text begins (one entry more than texts)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def pieces(bytes_: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind=pa.string()) -> pa.Array:
    """An Arrow array of the byte ranges, which must be ascending and disjoint."""
    if not len(starts):
        return pa.array([], kind)
    lengths = ends - starts
    if (starts[1:] == ends[:-1]).all():
        data, offsets = bytes_[starts[0] : ends[-1]], np.r_[0, np.cumsum(lengths)]
    else:
        inside = np.zeros(len(bytes_) + 1, np.int8)
        inside[starts[lengths > 0]] += 1
        inside[ends[lengths > 0]] -= 1
        data, offsets = bytes_[np.cumsum(inside[:-1], dtype=np.int8) > 0], np.r_[0, np.cumsum(lengths)]
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def word_ranges(bytes_: np.ndarray, begins: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other bytes than those of `gaps`, by default ASCII white space), and the first word of each text."""
    inside = np.zeros(len(bytes_) + 2, bool)
    inside[1:-1] = ~gaps[bytes_]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = begins[1:-1]
    edges = edges[(edges > 0) & (edges < len(bytes_))]
    opens[edges] |= inside[1:-1][edges]
    closes[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, begins)


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of equal values, and the distinct values they stand for."""
    if not len(values):
        return np.zeros(0, np.int64), values
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums over the ranges firsts[i] to firsts[i + 1]; an empty range gives 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]


def owners(firsts: np.ndarray) -> np.ndarray:
    """For each element, the range it lies in."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def dense(keys: np.ndarray) -> np.ndarray:
    """Small ids for equal keys."""
    return np.unique(keys, return_inverse=True)[1]


def joined_counts(group: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, code) pairs in order, with how often each occurs."""
    width = np.int64(codes.max() + 1) if len(codes) else np.int64(1)
    keys, n = np.unique(group.astype(np.int64) * width + codes, return_counts=True)
    return keys // width, keys % width, n


def mixed(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix of integer keys (multiply and shift rounds with odd constants)."""
    with np.errstate(over="ignore"):
        out = keys.astype(np.uint64, order="C", copy=True)
        flat = out.reshape(-1)
        for at in range(0, flat.size, IN_CACHE):
            x = flat[at : at + IN_CACHE]
            x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return out


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the values, the same on every machine."""
    bytes_, begins = raw_bytes(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(len(bytes_)) - np.repeat(begins[:-1], np.diff(begins))
        terms = mixed(bytes_.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)))
        total = np.zeros(len(bytes_) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        return mixed(total[begins[1:]] - total[begins[:-1]] + np.diff(begins).astype(np.uint64))
