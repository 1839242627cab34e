"""Near-duplicate vectors by a similarity join in epsilon grid order.

Unit vectors with a cosine of at least c lie at most eps = sqrt(2 - 2c) apart. They are turned to their
principal axes, and sorted by the cells of a grid of side eps along the leading ones, cell by cell in
lexicographic order. The sequence is cut into intervals, these into smaller ones and so on, each with the
box of its leading coordinates. A join of two intervals is a join of their parts; a pair whose boxes lie
more than eps apart is passed over with all its parts. Down to blocks of the sequence this is a join
of small tables of intervals; each pair of blocks that is left is one task's work, which goes on in the
same way down to short intervals, whose vectors are compared. Two intervals that lie in balls so close
that every pair is near are counted without a comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlark.llm.components import components
from flowlark.llm.order import in_order
from flowlark.session import cut_lineage

COSINE = 0.95
#: Leading principal dimensions of the grid.
AXES = 8
#: Vectors of the shortest intervals, and of a block: at most BLOCK_BYTES of doubles, fewer if tasks would be left without work.
SHORT, LEAST_BLOCK, BLOCK_BYTES = 256, 1024, 16 << 20
#: Parts of an interval above the blocks, and vectors in a row that is shuffled.
FAN, CHUNK = 8, 256
#: Copies of a vector that is repeated, so that the rows that repeat it need not meet in one task.
SALTS = 32
SLACK = 1e-9


def usable(v: Column) -> Column:
    """Whether an array is a vector with a direction: finite, not null, not all zero."""
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~broken & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of unit length, in double precision; a shorter vector is filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy().astype(np.int64))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    out /= np.abs(out).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def slices(batches, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def principal_axes(nodes: DataFrame, width: int, axes: int) -> np.ndarray:
    """The leading eigenvectors of the scatter of all unit vectors: a task sends one sum for each pair of dimensions."""

    def scatter(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for part in slices(batches):
            x = matrix(part.column(0), width)
            total += x.T @ x
        for i in range(width):
            yield pa.RecordBatch.from_pydict({"i": np.full(width, i, np.int32), "j": np.arange(width, dtype=np.int32), "s": total[i]})

    sums = nodes.select("embedding").mapInArrow(scatter, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    made = np.zeros((width, width))
    for r in sums.collect():  # width * width numbers
        made[r.i, r.j] = r.s
    return np.linalg.eigh((made + made.T) / 2)[1][:, ::-1][:, :axes]


def projected(nodes: DataFrame, axes: np.ndarray) -> DataFrame:
    """The vectors with x, their coordinates along the axes."""
    width = len(axes)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = matrix(part.column(1), width) @ axes
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, values], ["node", "embedding", "weight", "x"])

    schema = f"node long, embedding {nodes.schema['embedding'].dataType.simpleString()}, weight long, x array<double>"
    return nodes.select("node", "embedding", "weight").mapInArrow(run, schema)


def apart(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Square of the least distance of two boxes."""
    gap = F.zip_with(F.zip_with(lo_b, hi_a, lambda l, h: l - h), F.zip_with(lo_a, hi_b, lambda l, h: l - h), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g)


def near_blocks(rows: DataFrame, n_blocks: int, axes: int, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose boxes are at most eps apart, found from the whole sequence downwards."""
    bounds = [f(F.col("x")[i]).alias(f"{name}{i}") for name, f in (("l", F.min), ("h", F.max)) for i in range(axes)]
    boxes = rows.groupBy("block").agg(*bounds).select(F.col("block").alias("id"), F.array(*(f"l{i}" for i in range(axes))).alias("lo"), F.array(*(f"h{i}" for i in range(axes))).alias("hi"))
    levels, size = [cut_lineage(boxes)], n_blocks
    while size > 1:
        up = levels[-1].select((F.col("id") / FAN).cast("long").alias("id"), "lo", "hi")
        widest = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(axes)]
        levels.append(up.groupBy("id").agg(*widest).select("id", F.array(*(f"lo{i}" for i in range(axes))).alias("lo"), F.array(*(f"hi{i}" for i in range(axes))).alias("hi")))
        size = -(-size // FAN)
    top = levels.pop()
    pairs = top.select(F.col("id").alias("a"), F.col("id").alias("b"))
    while levels:
        parts = levels.pop().select((F.col("id") / FAN).cast("long").alias("of"), "id", "lo", "hi")
        left, right = (parts.select(F.col("of").alias(f"of_{s}"), F.col("id").alias(f"id_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")) for s in "ab")
        met = pairs.join(left, F.col("a") == F.col("of_a")).join(right, F.col("b") == F.col("of_b"))
        near = apart(*(F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b"))) <= (eps + SLACK) ** 2
        pairs = met.where(F.col("id_a") <= F.col("id_b")).where(near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return pairs


class Side:
    """The vectors of a block in sequence order, and boxes and balls of its intervals, worked out when asked for."""

    def __init__(self, vectors: np.ndarray, coordinates: np.ndarray, weight: np.ndarray, offset: int):
        self.vectors, self.coordinates, self.weight, self.offset = vectors, coordinates, weight, offset
        self.known: dict[tuple[int, int], tuple] = {}

    def bounds(self, lo: int, hi: int) -> tuple:
        if (lo, hi) not in self.known:
            x, v = self.coordinates[lo:hi], self.vectors[lo:hi]
            centre = v.mean(axis=0)
            radius = math.sqrt(max(((v - centre) ** 2).sum(axis=1).max(), 0.0))
            self.known[lo, hi] = (x.min(axis=0), x.max(axis=0), centre, radius)
        return self.known[lo, hi]


def roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = parent[at]
    while (parent[found] != found).any():
        found = parent[found]
    return found


def unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the sets of u[i] and v[i]; the least member stands for a set."""
    while len(u):
        a, b = roots(parent, u), roots(parent, v)
        differ = a != b
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def join_intervals(a: Side, b: Side, eps: float, cosine: float, links: np.ndarray, parent: np.ndarray) -> None:
    """Adds up in `links` the weights of the partners of each vector of both blocks, and joins linked ones in `parent`."""
    own = a is b
    waiting = [(0, len(a.vectors), 0, len(b.vectors))]
    while waiting:
        p, q, r, s = waiting.pop()
        same = own and p == r
        lo_a, hi_a, mid_a, far_a = a.bounds(p, q)
        lo_b, hi_b, mid_b, far_b = b.bounds(r, s)
        if not same:
            gap = np.maximum(np.maximum(lo_b - hi_a, lo_a - hi_b), 0)
            between = math.sqrt(((mid_a - mid_b) ** 2).sum())
            if (gap * gap).sum() > (eps + SLACK) ** 2 or between - far_a - far_b > eps + SLACK:
                continue
        else:
            between = 0.0
        if between + far_a + far_b < eps - 1e-6:
            weight_a, weight_b = a.weight[p:q], b.weight[r:s]
            links[a.offset + p : a.offset + q] += weight_b.sum() - (weight_a if same else 0)
            if not same:
                links[b.offset + r : b.offset + s] += weight_a.sum()
            every = np.r_[np.arange(a.offset + p, a.offset + q), np.arange(b.offset + r, b.offset + s)]
            unite(parent, np.full(len(every), every[0]), every)
        elif q - p <= SHORT and s - r <= SHORT:
            near = a.vectors[p:q] @ b.vectors[r:s].T >= cosine
            if same:
                np.fill_diagonal(near, False)
            if near.any():
                links[a.offset + p : a.offset + q] += near @ b.weight[r:s]
                if not same:
                    links[b.offset + r : b.offset + s] += a.weight[p:q] @ near
                i, j = np.nonzero(near)
                unite(parent, a.offset + p + i, b.offset + r + j)
        else:
            cuts_a = [(p, q)] if q - p <= SHORT else [(p, p + half(q - p)), (p + half(q - p), q)]
            cuts_b = [(r, s)] if s - r <= SHORT else [(r, r + half(s - r)), (r + half(s - r), s)]
            waiting += [(*x, *y) for x in cuts_a for y in cuts_b if not own or x[0] <= y[0]]


def half(n: int) -> int:
    """The first part of an interval of n, a whole number of short intervals."""
    return max(1, -(-n // SHORT) // 2) * SHORT


def linked(rows: DataFrame, pairs: DataFrame, axes: np.ndarray, eps: float, cosine: float) -> DataFrame:
    """(node, n, root) from each pair of blocks: what its partners there weigh, and a node it is connected with."""
    width = len(axes)
    packed = rows.groupBy("block", (F.col("position") / CHUNK).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("position", "node", "weight", "embedding"))).alias("members"))
    sides = pairs.select("a", "b", F.explode(F.expr("CASE WHEN a = b THEN array(a) ELSE array(a, b) END")).alias("block"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.join(packed, "block").select("a", "b", "block", "chunk", "members").repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "block", "chunk")

    def solved(parts: list[tuple]) -> pa.RecordBatch:
        block = np.concatenate([np.full(len(n), at) for at, n, _, _ in parts])
        node, weight, x = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        first = int((block == block[0]).sum())
        sides_ = [Side(x[lo:hi], x[lo:hi] @ axes, weight[lo:hi], lo) for lo, hi in ((0, first), (first, len(block))) if hi > lo]
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        if len(sides_) == 1:
            join_intervals(sides_[0], sides_[0], eps, cosine, links, parent)
        else:
            join_intervals(sides_[0], sides_[1], eps, cosine, links, parent)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_pydict({"node": node[some], "n": links[some], "root": node[roots(parent, some)]})

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                here = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if here != at:
                    if parts:
                        yield solved(parts)
                    at, parts = here, []
                members = batch.column(4).slice(i, 1).flatten()
                position, node, weight, embedding = members.flatten()
                parts.append((batch.column(2)[i].as_py(), node.to_numpy(), weight.to_numpy(), matrix(embedding, width)))
        if parts:
            yield solved(parts)

    return dealt.mapInArrow(run, "node long, n long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, axes: int = AXES) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding: array of numbers).

    Two vectors are linked if their cosine in double precision is at least `cosine` (above 0). n_links counts the other
    rows linked directly, component_id is the least vec_id reachable by links, kept says whether that is the row's own.

    A vector that is null, zero, or holds a null or non-finite number has no links; so has a row with a
    null vec_id, whose component_id is null and which is not kept. A shorter vector counts as filled up with
    zeros. Equal vectors are compared once, with their number; rows that repeat a vec_id are rows like
    others. Other columns are not looked at; an empty table gives an empty result.
    """
    eps = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # One node for each different vector; its rows are the others' partners with their number.
    nodes = cut_lineage(good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()))
    size = nodes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    spark = vectors.sparkSession
    if not size.n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    turned = principal_axes(nodes, size.width, min(axes, size.width))
    k = turned.shape[1]
    cells = [F.floor(F.col("x")[i] / eps) for i in range(k)]
    order = [*cells, *(F.col("x")[i] for i in range(k)), F.col("node")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(LEAST_BLOCK, BLOCK_BYTES // (8 * size.width))
    wanted = min(most, max(LEAST_BLOCK, -(-size.n // max(1, math.isqrt(2 * tasks)))))
    per_block = -(-wanted // CHUNK) * CHUNK
    placed = in_order(projected(nodes, turned), order).withColumn("block", (F.col("position") / per_block).cast("long"))
    pairs = near_blocks(placed, -(-size.n // per_block), k, eps)
    found = cut_lineage(linked(placed, pairs, turned, eps, cosine))
    connected = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    whole = nodes.join(connected, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = cut_lineage(whole.join(named, "component").select("embedding", "weight", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    single = facts.where("weight = 1").select(F.col("least").alias("vec_id"), "n_links", "component_id")
    # The rows of a repeated vector meet one of SALTS copies of its facts.
    again = facts.where("weight > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = good.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    repeated = dealt.join(again.select("embedding", "salt", "n_links", "component_id"), ["embedding", "salt"]).select("vec_id", "n_links", "component_id")
    unusable = F.col("vec_id").isNull() | ~F.coalesce(usable(F.col("embedding")), F.lit(False))
    alone = rows.where(unusable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = single.unionByName(repeated).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
