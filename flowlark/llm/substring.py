"""Substring deduplication over words, with super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlark.llm.text import BLOCK_BYTES, blocks, coded, freed, mixed, owners, pieces, raw_bytes, sums, word_hashes, word_ranges
from flowlark.llm.windows import Cut, covered, minimiser_runs, numbered, repeated_runs, with_runs

WINDOW = 13
#: Words of a minimiser.
GRAM = 3


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each run of `gram` words, from the hashes of its words."""
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(words) - gram + 1), np.uint64)
        for k in range(gram):
            total = mixed(total + words[k : k + len(total)], k)
    return total


def super_kmers(texts: pa.Array, window: int = WINDOW, gram: int = GRAM) -> Cut:
    """Packed strings: the words of consecutive windows with one minimiser, joined by a space."""
    bytes_, begins = raw_bytes(texts)
    starts, ends, firsts = word_ranges(bytes_, begins)
    codes, distinct = coded(pieces(bytes_, starts, ends, pa.binary()))
    order = gram_hashes(word_hashes(distinct)[codes], gram) if len(codes) else np.zeros(0, np.uint64)
    doc = owners(firsts)
    fits = doc[: max(0, len(doc) - window + 1)] == doc[window - 1 :]
    first, n, place = minimiser_runs(order, fits, window - gram + 1)
    lengths = ends - starts
    at = np.r_[0, np.cumsum(lengths + 1)]
    plain = np.full(int(at[-1]), 32, np.uint8)
    plain[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(starts)), lengths)] = bytes_[np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(int(lengths.sum()))] if len(starts) else 0
    raw = plain.tobytes()

    def strings(some: np.ndarray) -> list[bytes]:
        return [raw[a:b] for a, b in zip(at[first[some]].tolist(), (at[(first + n)[some] + window - 1] - 1).tolist())]

    return Cut(order[place], (place - first).astype(np.int32), doc[first], first - firsts[doc[first]], strings)


def least_by_sorting(strings: list[bytes], marks: np.ndarray, least: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string the least document that holds it. Windows are sorted by a hash;
    neighbours that agree in it are compared word for word."""
    raw = b" ".join(strings) + b" "
    stops = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts = np.r_[0, stops[:-1] + 1]
    words = np.fromiter((s.count(b" ") for s in strings), np.int64, len(strings)) + 1
    firsts = np.r_[0, np.cumsum(words - window + 1)]
    owner = owners(firsts)
    at = np.arange(firsts[-1]) - firsts[owner] + np.r_[0, np.cumsum(words)[:-1]][owner]
    values = least[owner].copy()
    hashes = word_hashes(pieces(np.frombuffer(raw, np.uint8), starts, stops, pa.binary()))
    gram_at = np.r_[0, np.cumsum(words)[:-1]] + marks
    _, group, size = np.unique(gram_hashes(hashes, gram)[gram_at], return_inverse=True, return_counts=True)
    busy = np.flatnonzero((size[group] > 1)[owner])  # a minimiser with one string has nothing to compare
    keys = gram_hashes(hashes, window)[at[busy]]
    order = busy[np.argsort(keys, kind="stable")]
    keys = np.sort(keys)
    same = np.r_[False, keys[1:] == keys[:-1]]
    spans = list(zip(starts[at[order]].tolist(), stops[at[order] + window - 1].tolist()))
    for i in np.flatnonzero(same).tolist():
        (a, b), (c, d) = spans[i - 1], spans[i]
        if raw[a:b] != raw[c:d]:
            return least_exactly([raw[a:b] for a, b in zip(starts[at].tolist(), stops[at + window - 1].tolist())], values), firsts
    if len(order):
        heads = np.flatnonzero(~same)
        values[order] = np.repeat(np.minimum.reduceat(values[order], heads), np.diff(np.r_[heads, len(order)]))
    return values, firsts


def least_exactly(windows: list[bytes], values: np.ndarray) -> np.ndarray:
    """The same by sorting the windows themselves; for when a hash does not tell two apart."""
    order = sorted(range(len(windows)), key=windows.__getitem__)
    heads = [i for i, k in enumerate(order) if i == 0 or windows[k] != windows[order[i - 1]]]
    out = values.copy()
    out[order] = np.repeat(np.minimum.reduceat(values[order], heads), np.diff([*heads, len(order)]))
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Each row of docs (doc_id, text) without the words that lie in a window of `window` words which
    also starts in a document with a smaller doc_id.

    Words are runs of bytes other than ASCII white space; windows are judged on the texts as given.
    Result: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), and with
    `texts` the kept words (`kept_text`) and the given `text`; `keep` passes further columns on. A null text has no words. Rows with a
    null doc_id are kept whole and remove nothing elsewhere. Rows that repeat a doc_id are the same
    document: neither removes from the other. Other columns are not looked at; an empty table gives
    an empty result.
    """
    keep = keep or []
    rows = numbered(docs, keep)

    def cut(column: pa.Array) -> Cut:
        return super_kmers(column, window)

    def least(strings: list[bytes], marks: np.ndarray, docs_: np.ndarray) -> tuple:
        return least_by_sorting(strings, marks, docs_, window)

    runs = repeated_runs(rows, cut, least, 3.2)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, text string" * texts
    schema += "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def apply(batches) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            bytes_, begins = raw_bytes(block.column(1))
            starts, ends, firsts = word_ranges(bytes_, begins)
            gone = covered(block, firsts, window)
            words = pieces(bytes_, starts, ends, pa.binary()).to_pylist()
            kept = [b" ".join([w for w, g in zip(words[a:b], gone[a:b].tolist()) if not g]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            out = {"doc_id": block.column(0), "n_words": np.diff(firsts), "n_removed": sums(gone, firsts), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
            more = {"kept_text": [k.decode() for k in kept], "text": block.column(1)} if texts else {}
            yield pa.RecordBatch.from_pydict(out | more | {k: block.column(block.schema.get_field_index(k)) for k in keep})

    return with_runs(rows, runs).mapInArrow(freed(apply), schema)
