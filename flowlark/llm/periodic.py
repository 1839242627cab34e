"""Periodic runs of words: Lyndon roots from the first phase of Baier's suffix sorter, extended into runs.

A run of period q has Lyndon roots of q words under one of two orders of the words (one the reverse
of the other), and each of them is the longest Lyndon word that starts at its place. The first phase
of the sorter puts suffixes into groups by just that word, from the highest group down: a suffix whose
group is done hands its word over to the next smaller suffix before it, whose word grows by it. So the
length of a group's word is the Lyndon array, with no suffix array. Each root, prolonged to the left
and right as far as words one period apart agree (longest common extensions), gives its run.

Only stretches that can lie in a run are grouped: in a run of exponent 4 or more, every three
words within it recur at a distance of at most a fourth of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlark.llm.text import BLOCK_BYTES, blocks, coded, dense, owners, pieces, raw_bytes, sums, word_ranges

LEAST, EXPONENT = 6, 4
#: Words of a short window that must recur near by.
GRAM = 3


def lyndon_lengths(codes: list[int], heads: list[bool]) -> tuple[list[int], list[int]]:
    """Length of the longest Lyndon word from each place on, and its group (the same for equal words); strings
    begin where heads is true.

    Groups are kept in descending order and taken from the highest down. Each place is moved up once for
    each different group that ends at it, and passed over once in the search for smaller groups.
    """
    n = len(codes)
    out, before, done = [0] * n, [-1] * n, [False] * n
    group, members, size, lower = [0] * n, [], [], []
    values = sorted(set(codes))
    number = {v: i for i, v in enumerate(values)}
    members = [[] for _ in values]
    size, lower, higher = [1] * len(values), list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))
    for i, v in enumerate(codes):
        group[i] = g = number[v]
        members[g].append(i)
    if n:
        higher[-1] = -1
    g = len(values) - 1
    while g >= 0:
        length = size[g]
        handed: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for i in members[g]:
            if group[i] != g:
                continue
            j = -1 if heads[i] else i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i], done[i], out[i] = j, True, length
            if j == last:
                times += 1
            else:
                if last >= 0:
                    handed.setdefault((group[last], times), []).append(last)
                last, times = j, 1
        if last >= 0:
            handed.setdefault((group[last], times), []).append(last)
        members[g] = []
        # The word of a place followed by more repeats is the greater one: least repeats stay next to the old group.
        for (old, times), places in sorted(handed.items(), key=lambda x: -x[0][1]):
            new = len(size)
            size.append(size[old] + times * length)
            members.append(places)
            up = higher[old]
            lower.append(old)
            higher.append(up)
            higher[old] = new
            if up >= 0:
                lower[up] = new
            for p in places:
                group[p] = new
        g = lower[g]
    return out, group


def near_distances(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each place the distance to the nearest equal window of GRAM words in its text; a large number if none."""
    n, doc = len(codes), owners(firsts)
    none = np.iinfo(np.int64).max
    out = np.full(n, none)
    gram = codes.astype(np.int64)
    width = int(codes.max()) + 2 if n else 2
    for k in range(1, GRAM):
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = codes[k:] + 1
        gram = dense(gram * width + ahead)
    at = np.flatnonzero(np.arange(n) + GRAM <= firsts[1:][doc]) if n else np.zeros(0, np.int64)
    if len(at):
        order = at[np.argsort(dense(gram[at] + doc[at] * (int(gram.max()) + 1)), kind="stable")]
        same = (gram[order[1:]] == gram[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        gap = np.where(same, order[1:] - order[:-1], none)
        np.minimum.at(out, order[1:], gap)
        np.minimum.at(out, order[:-1], gap)
    return out


def stretches(codes: np.ndarray, firsts: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches outside of which no run lies.

    Windows whose nearest equal lies further away than a run within their stretch can have as period
    are left out, until none is.
    """
    distance = near_distances(codes, firsts)
    doc = owners(firsts)
    keep = distance < np.iinfo(np.int64).max
    while True:
        at = np.flatnonzero(keep)
        if not len(at):
            return at, at
        edge = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])])
        start, stop = at[edge], at[np.r_[edge[1:], len(at)] - 1] + GRAM
        long = stop - start
        of = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(at)]))
        stay = (long[of] >= least) & (distance[at] * exponent <= long[of])
        if stay.all():
            return start, stop
        keep[at[~stay]] = False


class Extensions:
    """Longest common extensions by ids of equal blocks of 1, 2, 4, ... places; strings do not join."""

    def __init__(self, codes: np.ndarray, firsts: np.ndarray):
        self.begin, self.end = (np.repeat(x, np.diff(firsts)) for x in (firsts[:-1], firsts[1:]))
        self.ids = [codes.astype(np.int64)]
        longest, step = int(np.diff(firsts).max(initial=0)), 1
        while 2 * step <= longest:
            now = self.ids[-1]
            ahead = np.zeros(len(now), np.int64)
            ahead[: len(now) - step] = now[step:] + 1
            self.ids.append(dense(now * (int(now.max()) + 2) + ahead))
            step *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many places from a and b (a < b, in one string) on agree; b may be its end."""
        end, n = self.end[a], np.zeros(len(a), np.int64)
        for k in range(len(self.ids) - 1, -1, -1):
            step, ids = 1 << k, self.ids[k]
            at = np.flatnonzero(b + n + step <= end)
            n[at[ids[a[at] + n[at]] == ids[b[at] + n[at]]]] += step
        return n

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many places before a and b (a < b, in one string) agree."""
        begin, n = self.begin[a], np.zeros(len(a), np.int64)
        for k in range(len(self.ids) - 1, -1, -1):
            step, ids = 1 << k, self.ids[k]
            at = np.flatnonzero(a - n - step >= begin)
            n[at[ids[a[at] - n[at] - step] == ids[b[at] - n[at] - step]]] += step
        return n


def runs_of(codes: np.ndarray, firsts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start, then period; places count through all texts."""
    lo, hi = stretches(codes, firsts, least, exponent)
    lengths = hi - lo
    begins = np.r_[0, np.cumsum(lengths)]
    place = np.repeat(lo - begins[:-1], lengths) + np.arange(int(lengths.sum()))
    own = dense(codes[place]).astype(np.int64) if len(place) else place
    heads = np.zeros(len(place), bool)
    heads[begins[:-1]] = True
    found = Extensions(own, begins)
    parts = []
    for order in (own, own.max(initial=0) - own):
        period, root = (np.array(x, np.int64) for x in lyndon_lengths(order.tolist(), heads.tolist()))
        at = np.flatnonzero(np.arange(len(place)) + period < found.end)
        # Of equal roots that follow each other only the first is prolonged.
        earlier = at - period[at]
        first = (earlier < found.begin[at]) | (root[np.maximum(earlier, 0)] != root[at])
        at = at[first]
        p = period[at]
        right, left = found.forward(at, at + p), found.backward(at, at + p)
        length = p + right + left
        good = (length >= least) & (length >= exponent * p)
        parts.append(np.stack([place[(at - left)[good]], length[good], p[good]]))
    start, length, period = np.concatenate(parts, axis=1)
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (period[1:] != period[:-1])][: len(start)]
    return start[new], length[new], period[new]


def dropped_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, texts: bool = False) -> DataFrame:
    """Runs of each row of docs (doc_id, text): doc_id, n_words, runs and kept_text.

    Words lie between ASCII white space. A run is a stretch of words with smallest period q, at least
    max(least, exponent * q) long (`exponent` is 4 or more, `least` 6 or more), that can be prolonged on neither
    side. runs lists (start, length, period) by start, then period, counted in words from 0.
    collapsed_sha256 is the digest of the words left, joined by one space, when each run keeps its first
    period only; with `texts`, kept_text holds them.

    A null text counts as empty: no words, no runs. A null doc_id stays null, repeated rows give
    repeated results, other columns are not looked at, an empty table gives an empty result. Texts are
    read whole, one block of whole texts at a time.
    """
    if least < 2 * GRAM or exponent < 4:
        raise ValueError("runs need at least 6 words and 4 periods")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            bytes_, begins = raw_bytes(block.column(1))
            starts, ends, firsts = word_ranges(bytes_, begins)
            codes, _ = coded(pieces(bytes_, starts, ends, pa.binary()))
            start, length, period = runs_of(codes, firsts, least, exponent)
            gone = dropped_words(len(codes), start, length, period)
            # The words left of a text, each followed by a space, lie in one stretch of bytes.
            sizes = np.where(gone, 0, ends - starts + 1)
            at = np.r_[0, np.cumsum(sizes)]
            source = np.repeat(starts - at[:-1], sizes) + np.arange(int(at[-1]))
            space = at[1:][~gone] - 1
            rest = np.r_[bytes_, np.uint8(32)][np.minimum(source, len(bytes_))]
            rest[space] = 32
            rest, cuts = rest.tobytes(), at[firsts].tolist()
            left = [rest[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:])]
            doc = np.searchsorted(firsts, start, "right") - 1
            edges = np.searchsorted(doc, np.arange(len(begins)))
            values = pa.StructArray.from_arrays([pa.array(x) for x in (start - firsts[doc], length, period)], ["start", "length", "period"])
            out = {"doc_id": block.column(0), "n_words": np.diff(firsts), "runs": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values), "collapsed_sha256": [hashlib.sha256(t).hexdigest() for t in left]}
            yield pa.RecordBatch.from_pydict(out | ({"kept_text": pa.array(left, pa.binary()).cast(pa.string())} if texts else {}))

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_sha256 string" + ", kept_text string" * texts
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digested(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length (ties: smallest start, then period), and digests."""
    key = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    line = F.transform("runs", lambda r: F.concat(*(x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ",")))))
    best = found.withColumn("best", F.array_min(key)).withColumn("lines", F.array_join(line, ""))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.n div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten (by checksum of its doc_id) repeats its own words from some word on.

    With h the checksum and g = h div 10, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8) for n words. Other texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = F.expr(r"filter(split(text, '[ \\t\\n\\x0B\\f\\r]+'), w -> w <> '')")
    made = rows.select("doc_id", "text", (h % 10 == 0).alias("turn"), F.floor(h / 10).alias("g"))
    made = made.withColumn("words", F.when(F.col("turn"), words)).withColumn("n", F.size("words").cast("long"))
    made = made.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    made = made.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    turned = F.expr("array_join(concat(slice(words, 1, int(a)), transform(sequence(0, int(n - a) - 1), k -> words[int(a + k % p)])), ' ')")
    return made.select("doc_id", F.when(F.col("turn") & (F.col("n") > 0), turned).otherwise(F.col("text")).alias("text"))
