"""Exact nearest neighbours of wide vectors, of which no pair can be ruled out beforehand.

Rows are dealt evenly into chunks, and every two chunks meet once, in a tile: one task, one matrix product for both directions.
First each query meets a few thousand reference rows, which bounds its k-th distance; a tile then keeps only pairs within the
bound, at most k for a query. Memory is two chunks a task. The number of pairs stays the square of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.session import cut_lineage

#: Bytes of a chunk's vectors, rows that bound a query's k-th distance, and least rows of a chunk.
CHUNK_BYTES, CELL_ROWS, LEAST_ROWS = 64 * 1024 * 1024, 16_384, 4096
#: Sides of one matrix product.
LEFT_ROWS, RIGHT_ROWS = 1024, 1024
#: Pairs that are kept before they are cut to k for a query, and rows of a packed result.
MOST_FINDS, OUT_ROWS = 2_000_000, 100_000
SLACK = 1e-9
PACKED = "slot int, number array<bigint>, neighbor array<bigint>, distance array<double>"


class Side:
    """Rows of a tile: their numbers, the least number with the same id, the vectors, which can be neighbours, bounds of the k-th distance."""

    def __init__(self, table: pa.Table, width: int):
        self.number, self.own, self.kept, self.edge, self.slot = (table[c].to_numpy() for c in ("number", "own", "kept", "edge", "slot"))
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.rows = flat.reshape(table.num_rows, width)  # fails on vectors of another width

    def places(self, kept: bool) -> np.ndarray:
        """Rows that can be neighbours, or the others, by bound: rows with wide bounds are searched together."""
        some = np.flatnonzero(self.kept == kept)
        return some[np.argsort(self.edge[some], kind="stable")]


class Finds:
    """The k nearest reference rows of each query, of all pairs added; ties by id."""

    def __init__(self, queries: Side, reference: Side, k: int, skip_self: bool):
        self.queries, self.reference, self.k, self.skip_self = queries, reference, k, skip_self
        self.held, self.fresh, self.n = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def add(self, q: np.ndarray, r: np.ndarray) -> None:
        if self.skip_self:
            other = self.queries.own[q] != self.reference.own[r]
            q, r = q[other], r[other]
        self.fresh.append((q, r))
        self.n += len(q)
        if self.n > MOST_FINDS:
            self.first_k()

    def first_k(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [self.held]
        for q, r in self.fresh:
            for at in range(0, len(q), OUT_ROWS):
                a, b = q[at : at + OUT_ROWS], r[at : at + OUT_ROWS]
                with np.errstate(over="ignore"):
                    gap = np.sqrt(((self.queries.rows[a].astype(float) - self.reference.rows[b].astype(float)) ** 2).sum(axis=1))
                fine = np.isfinite(gap) & (gap <= self.queries.edge[a])
                parts.append((a[fine], b[fine], gap[fine]))
        self.held = cut_to_k(*(np.concatenate(c) for c in zip(*parts)), self.reference.own, self.k)
        self.fresh, self.n = [], 0
        return self.held

    def packed(self) -> Iterator[pa.RecordBatch]:
        q, r, gap = self.first_k()
        for at in range(0, len(q), OUT_ROWS):
            a, b, g = (x[at : at + OUT_ROWS] for x in (q, r, gap))
            made = [pa.array([x], pa.list_(t)) for x, t in ((self.queries.number[a], pa.int64()), (self.reference.own[b], pa.int64()), (g, pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([self.queries.slot[0]], pa.int32()), *made], names=["slot", "number", "neighbor", "distance"])


def cut_to_k(q: np.ndarray, r: np.ndarray, gap: np.ndarray, order_of: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((r if order_of is None else order_of[r], gap, q))
    q, r, gap = q[order], r[order], gap[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], r[first], gap[first]


def close_pairs(a: np.ndarray, b: np.ndarray, edge_a: np.ndarray, edge_b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a, place in b, near for a, near for b): all pairs within the bound of either, and some more that rounding leaves open.

    Products are in single precision, of centred rows in units of the greatest component, so that no square leaves its range.
    """
    if not len(a) or not len(b):
        return
    a, b = a.astype(float), b.astype(float)
    if max(np.abs(a).max(), np.abs(b).max()) < 1e150:
        center = b.mean(axis=0)
        a, b = a - center, b - center
    unit = max(np.abs(a).max(), np.abs(b).max()) or 1.0
    a, b = a / unit, b / unit
    size_a, size_b = (a**2).sum(axis=1), (b**2).sum(axis=1)
    left = np.concatenate([-2 * a, size_a[:, None], np.ones((len(a), 1))], axis=1).astype(np.float32)
    right = np.concatenate([b, np.ones((len(b), 1)), size_b[:, None]], axis=1).astype(np.float32)

    def limit(edge: np.ndarray, size: np.ndarray, others: np.ndarray) -> np.ndarray:
        error = 16 * (a.shape[1] + 8) * np.finfo(np.float32).eps * (size + others.max())
        with np.errstate(over="ignore"):
            return ((edge / unit * (1 + SLACK)) ** 2 + error).astype(np.float32)

    most_a = limit(edge_a, size_a, size_b)
    most_b = None if edge_b is None else limit(edge_b, size_b, size_a)
    values, mask = np.empty(LEFT_ROWS * RIGHT_ROWS, np.float32), np.zeros(-(-LEFT_ROWS * RIGHT_ROWS // 8) * 8, bool)
    eights = np.arange(8)
    for i in range(0, len(a), LEFT_ROWS):
        here = left[i : i + LEFT_ROWS]
        top = most_a[i : i + LEFT_ROWS].max()
        for j in range(0, len(b), RIGHT_ROWS):
            there = right[j : j + RIGHT_ROWS]
            n = len(here) * len(there)
            np.matmul(here, there.T, out=values[:n].reshape(len(here), len(there)))
            most = top if most_b is None else max(top, most_b[j : j + RIGHT_ROWS].max())
            np.less_equal(values[:n], most, out=mask[:n])
            # Few pairs are near, so eight marks are looked at together.
            some = np.flatnonzero(mask.view(np.uint64)[: -(-n // 8)])
            if len(some):
                at = (some[:, None] * 8 + eights)[mask.reshape(-1, 8)[some]]
                at = at[at < n]
                q, r = np.divmod(at, len(there))
                q, r, found = q + i, r + j, values[at]
                yield q, r, found <= most_a[q], found <= most_b[r] if most_b is not None else np.zeros(len(q), bool)


def compared(a: Side, b: Side | None, k: int, skip_self: bool, both: bool) -> Iterator[pa.RecordBatch]:
    """Packed finds of a tile: a's queries among b's rows and, if both, the other way round; without b, a's among its own."""
    own = Finds(a, a if b is None else b, k, skip_self)
    back = Finds(b, a, k, skip_self) if both and b is not None else None
    other = a if b is None else b
    few = other.places(True)
    for some, way in ((a.places(True), back), (a.places(False), None)):
        for q, r, near, near_back in close_pairs(a.rows[some], other.rows[few], a.edge[some], other.edge[few] if way else None):
            own.add(some[q[near]], few[r[near]])
            if way:
                way.add(few[r[near_back]], some[q[near_back]])
    yield from own.packed()
    if back:
        some, few = b.places(False), a.places(True)
        for q, r, near, _ in close_pairs(b.rows[some], a.rows[few], b.edge[some], None):
            back.add(some[q[near]], few[r[near]])
        yield from back.packed()


def chunks_of(rows: DataFrame, chunks: int) -> Column:
    return F.pmod(F.xxhash64("number"), F.lit(chunks)).cast("int")


def in_order(reference: DataFrame, k: int) -> DataFrame:
    """number (growing with the id), own (the least number with that id), id, vector, and `kept`: whether the row can be among any k nearest.

    Of equal vectors at least the k + 1 least ids are kept, each at most k times.
    """
    ordered = reference.repartitionByRange("id", F.xxhash64("vector")).sortWithinPartitions("id")
    rows = cut_lineage(ordered.select(F.monotonically_increasing_id().alias("number"), "id", "vector"))
    rows = rows.join(rows.groupBy("id").agg(F.min("number").alias("own")), "id")
    copy = F.row_number().over(Window.partitionBy("vector", "own").orderBy("number"))
    once = rows.select("number", "own", "vector").withColumn("copy", copy).filter(F.col("copy") <= k)
    place = F.row_number().over(Window.partitionBy("vector").orderBy("number"))
    least = once.withColumn("place", place).filter(F.col("place") <= k * (k + 1)).select("number", F.lit(True).alias("kept"))
    return cut_lineage(rows.join(least, "number", "left").withColumn("kept", F.coalesce("kept", F.lit(False))))


def nearest_by_tiles(queries: DataFrame | None, reference: DataFrame, k: int, skip_self: bool, n: int, width: int, chunk_rows: int | None = None) -> DataFrame:
    """(id, neighbor, distance) as `neighbors.nearest`; queries: None for the reference rows themselves. All vectors are finite points."""
    cores = reference.sparkSession.sparkContext.defaultParallelism
    chunk_rows = chunk_rows or max(1, CHUNK_BYTES // (8 * width))

    def many(rows: int, least: int) -> int:
        return max(1, -(-rows // chunk_rows), min(least, -(-rows // LEAST_ROWS)))

    name = F.coalesce("id", F.lit("None")).alias("id")
    single = F.forall("vector", lambda x: x.cast("float").cast("double") == x)
    alike = queries is None
    vector = "array<double>"
    if reference.agg(F.bool_and(single).alias("s")).first()["s"] and (alike or queries.agg(F.bool_and(single).alias("s")).first()["s"] is not False):
        vector = "array<float>"
    known = in_order(reference.select(name, F.col("vector").cast(vector).alias("vector")), k)
    if alike:
        asked, q_chunks = known, many(n, int((8 * cores) ** 0.5) + 1)
        r_chunks = q_chunks
    else:
        asked = queries.select(F.monotonically_increasing_id().alias("number"), name, F.col("vector").cast(vector).alias("vector"))
        owners = known.select("id", "own").distinct()
        asked = cut_lineage(asked.join(owners, "id", "left").select("number", F.coalesce("own", F.lit(-1)).alias("own"), "id", "vector", F.lit(False).alias("kept")))
        r_chunks = many(n, 1)
        q_chunks = many(asked.count(), -(-4 * cores // r_chunks))

    columns = ["number", "own", "kept", "edge", "slot", "vector", "side"]
    far = F.lit(float("inf"))

    def sides(batches: Iterator[pa.RecordBatch]) -> list[Side | None]:
        """The left side, the right side, and a chunk that meets itself."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return [None, None, None]
        table = pa.Table.from_batches(held)
        kinds = table["side"].to_numpy()
        return [Side(table.filter(pa.array(kinds == s)), width) if (kinds == s).any() else None for s in (0, 1, 2)]

    def bounded(batches) -> Iterator[pa.RecordBatch]:
        from flowlark.operators.neighbors import Index

        a, cell, _ = sides(batches)
        if a is None:
            return
        edge = np.full(len(a.number), np.inf)
        if cell is not None:
            q, _, gap = Index(cell.rows.astype(float), cell.own, k).search(a.rows.astype(float), a.own, skip_self)
            last = np.r_[q[1:] != q[:-1], True] if len(q) else np.zeros(0, bool)
            whole = np.bincount(q, minlength=len(edge))[q[last]] >= k if len(q) else np.zeros(0, bool)
            edge[q[last][whole]] = gap[last][whole]
        for at in range(0, len(edge), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            yield pa.RecordBatch.from_pydict({"number": a.number[part], "edge": edge[part]})

    # Every chunk of queries meets one cell of reference rows.
    cells = max(1, n // CELL_ROWS)
    of_cell = F.filter(F.sequence(F.lit(0), F.lit(q_chunks - 1)), lambda t: t % cells == F.pmod(F.xxhash64("own", F.lit("cell")), F.lit(cells)))
    left = asked.select("number", "own", "kept", far.alias("edge"), F.lit(0).alias("slot"), "vector", F.lit(0).alias("side"), chunks_of(asked, q_chunks).alias("tile"))
    right = known.filter("kept").select("number", "own", "kept", far.alias("edge"), F.lit(0).alias("slot"), "vector", F.lit(1).alias("side"), F.explode(of_cell).alias("tile"))
    edges = left.unionByName(right).repartitionById(q_chunks, "tile").select(*columns).mapInArrow(bounded, "number bigint, edge double")
    asked = cut_lineage(asked.join(edges, "number"))

    # Tiles: every two chunks of the same rows, or every chunk of queries with every one of the others.
    own, q_slot, r_slot = F.col("slot"), chunks_of(asked, q_chunks), chunks_of(known, r_chunks)
    kept_columns = ["number", "own", "kept", "edge", "vector"]
    if alike:
        tiles = q_chunks * (q_chunks + 1) // 2
        high, low = F.greatest("other", "slot"), F.least("other", "slot")
        sent = asked.select(*kept_columns, q_slot.alias("slot")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(q_chunks - 1))))
        sent = sent.withColumn("tile", (high * (high + 1) / 2).cast("int") + low).withColumn("side", F.when(own == F.col("other"), 2).otherwise((own > F.col("other")).cast("int")))
    else:
        tiles = q_chunks * r_chunks
        sent = asked.select(*kept_columns, q_slot.alias("slot"), F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(r_chunks - 1))).alias("other"))
        sent = sent.withColumn("tile", own * r_chunks + F.col("other"))
        met = known.filter("kept").select("number", "own", "kept", far.alias("edge"), "vector", r_slot.alias("slot"), F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(q_chunks - 1))).alias("other"))
        sent = sent.unionByName(met.withColumn("tile", F.col("other") * r_chunks + own))

    def in_tile(batches) -> Iterator[pa.RecordBatch]:
        a, b, chunk = sides(batches)
        if chunk is not None:
            yield from compared(chunk, None, k, skip_self, False)
        elif a is not None and b is not None:
            yield from compared(a, b, k, skip_self, alike)

    found = sent.repartitionById(tiles, "tile").select(*columns).mapInArrow(in_tile, PACKED)

    def best(batches) -> Iterator[pa.RecordBatch]:
        held, more, n_more = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

        def cut():
            return cut_to_k(*(np.concatenate(c) for c in zip(held, *more)), None, k)

        for batch in batches:
            more.append(tuple(c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[1:]))
            n_more += len(more[-1][0])
            if n_more > MOST_FINDS:
                held, more, n_more = cut(), [], 0
        number, neighbor, distance = cut()
        for at in range(0, len(number), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            yield pa.RecordBatch.from_pydict({"number": number[part], "own": neighbor[part], "distance": distance[part]})

    nearest = found.repartitionById(q_chunks, "slot").mapInArrow(best, "number bigint, own bigint, distance double")
    ids = known.filter(F.col("number") == F.col("own")).select("own", F.col("id").alias("neighbor"))
    return nearest.join(asked.select("number", "id"), "number").join(ids, "own").select("id", "neighbor", "distance")
