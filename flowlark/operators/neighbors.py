"""Exact nearest neighbours, majority vote, and interpolated minority rows.

The reference rows are broadcast as one matrix when their measured size, ids included, allows. Beyond that they are cut into
blocks: each row belongs to its nearest pivot, and a pivot's rows are cut into rings by their distance to it. By the
triangle inequality a ring's least and greatest distance bound how near any of its rows can be to a query, so a query first
searches one ring near it and then only the rings that could still hold something nearer than its k-th find.
Few-dimensional blocks have bounding boxes as well. Inside a matrix or block, `Index` searches. In many dimensions these bounds
rule next to nothing out, and `tiles` compares all pairs, dealt evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from flowlark.functions.expr import hash_order, hash_unit
from flowlark.operators.scale import checked_small, quota_cuts, within_cut
from flowlark.operators.tiles import nearest_by_tiles
from flowlark.session import cut_lineage

BROADCAST_BYTES = 64 * 1024 * 1024
#: Most rows of a block: as many as fill this with their vectors.
BLOCK_BYTES, BLOCK_ROWS = 64 * 1024 * 1024, 200_000
WORK_CELLS = 4_000_000
#: Up to this width rows are searched by a tree, with leaves of so many rows; a group of queries looks at so many leaves first.
TREE_WIDTH, LEAF_ROWS, FIRST_LEAVES = 7, 64, 6
#: Sides of one matrix product, and most vector bytes or rows of queries that are searched together.
PRODUCT_QUERIES, PRODUCT_ROWS = 256, 4096
OUT_ROWS = 50_000
QUERY_BYTES, QUERY_ROWS = 16 * 1024 * 1024, 200_000
PIVOTS = 1024
RINGS = 64
#: Most different labels whose votes are counted beside each other.
MOST_LABELS = 32
#: Bounds are widened by this share of the distances they come from, far beyond the rounding of a distance.
SLACK = 1e-9
FOUND = "id string, neighbor string, distance double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


class Index:
    """Rows to search, made ready once by a task. Of equal vectors the k + 1 least ids are kept, each at most k times.

    Below eight dimensions rows lie in leaves of a balanced tree, and queries near each other only meet leaves whose
    box can hold a nearer row. Beyond that all rows are compared by matrix products, whose rounding is bounded.
    Distances that are given out, and all ties, are those of `distances`.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, k: int):
        names, rank = np.unique(ids, return_inverse=True)
        kept = least_copies(rows, rank, k)
        self.names, self.rank, self.rows, self.at, self.k = names, rank[kept], rows[kept], kept, k
        self.width = rows.shape[1] if rows.ndim == 2 else 0
        self.low = self.high = None
        if 0 < self.width <= TREE_WIDTH and len(kept):
            self.order_by_leaves()

    def order_by_leaves(self) -> None:
        order, sizes = near_groups(self.rows, LEAF_ROWS)
        self.rank, self.rows, self.at = self.rank[order], self.rows[order], self.at[order]
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.low = np.minimum.reduceat(self.rows, self.starts[:-1], axis=0)
        self.high = np.maximum.reduceat(self.rows, self.starts[:-1], axis=0)

    def search(self, queries: np.ndarray, own: np.ndarray, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays (query number, row number, distance): the k nearest rows of each query, ties by id."""
        parts = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))]
        if len(self.rows) and len(queries) and self.k > 0:
            mine = np.full(len(queries), -1)
            if skip_self:
                at = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
                mine = np.where(self.names[at] == own, at, -1)
            if max(np.abs(queries).max(initial=0), np.abs(self.rows).max(initial=0)) > 1e150:
                found = self.plain(queries, mine)
            else:
                found = self.by_leaves(queries, mine) if self.low is not None else self.by_products(queries, mine)
            for group, q, r in found:
                parts.append(self.first_k(queries, group, q, r, mine))
        return tuple(np.concatenate(column) for column in zip(*parts))

    def first_k(self, queries, group, q, r, mine):
        """The k nearest of the pairs (group[q], r), which hold all that can be among them."""
        other = mine[group[q]] != self.rank[r]
        q, r = q[other], r[other]
        with np.errstate(over="ignore"):
            gap = np.sqrt(((queries[group[q]] - self.rows[r]) ** 2).sum(axis=1))
        fine = np.isfinite(gap)
        q, r, gap = q[fine], r[fine], gap[fine]
        order = np.lexsort((self.rank[r], gap, q))
        q, r, gap = q[order], r[order], gap[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return group[q[first]], self.at[r[first]], gap[first]

    def plain(self, queries, mine):
        """Every pair, for components whose squares may not be finite."""
        step = max(1, WORK_CELLS // max(self.rows.size, len(self.rows)))
        for start in range(0, len(queries), step):
            group = np.arange(start, min(start + step, len(queries)))
            gaps = distances(queries[group], self.rows)
            gaps[mine[group, None] == self.rank[None, :]] = np.inf
            edge = np.partition(gaps, min(self.k, len(self.rows)) - 1, axis=1)[:, min(self.k, len(self.rows)) - 1]
            yield group, *np.nonzero((gaps <= edge[:, None]) & np.isfinite(gaps))

    def by_leaves(self, queries, mine):
        order, sizes = near_groups(queries, LEAF_ROWS)
        groups = np.split(order, np.cumsum(sizes)[:-1])
        while groups:
            group = groups.pop()
            here = queries[group]
            gaps = np.maximum(0, np.maximum(self.low - here.max(axis=0), here.min(axis=0) - self.high))
            gaps = squares(gaps.T, np.zeros((self.width, 1)))[0]
            few = min(FIRST_LEAVES, len(gaps))
            near = self.rows_of(np.argpartition(gaps, few - 1)[:few])
            part = squares(self.rows[near].T, here.T)
            part[mine[group, None] == self.rank[None, near]] = np.inf
            edge = np.full(len(group), np.inf)
            if len(near) >= self.k:
                edge = np.partition(part, self.k - 1, axis=1)[:, self.k - 1] * (1 + SLACK)
            leaves = np.flatnonzero(gaps <= edge.max())
            rows = self.rows_of(leaves)
            if len(rows) * len(group) > WORK_CELLS and len(group) > 1:
                order, sizes = near_groups(here, -(-len(group) // 2))
                groups += np.split(group[order], np.cumsum(sizes)[:-1])
                continue
            q, r = np.nonzero(squares(self.rows[rows].T, here.T) <= edge[:, None])
            yield group, q, rows[r]

    def rows_of(self, leaves: np.ndarray) -> np.ndarray:
        size = self.starts[leaves + 1] - self.starts[leaves]
        return np.repeat(self.starts[leaves] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def by_products(self, queries, mine):
        # In single precision, in units of the greatest component, so that no square leaves its range.
        unit = max(np.abs(queries).max(initial=0), np.abs(self.rows).max(initial=0)) or 1.0
        rows = self.rows / unit
        norm = (rows**2).sum(axis=1)
        right = np.concatenate([rows, norm[:, None]], axis=1).astype(np.float32)
        for start in range(0, len(queries), PRODUCT_QUERIES):
            group = np.arange(start, min(start + PRODUCT_QUERIES, len(queries)))
            here = queries[group] / unit
            left = np.concatenate([-2 * here, np.ones((len(group), 1))], axis=1).astype(np.float32)
            # Products give the square of the distance less that of the query, up to half this error.
            error = (16 * (self.width + 8) * np.finfo(np.float32).eps * ((here**2).sum(axis=1) + norm.max())).astype(np.float32)
            best = np.full((len(group), self.k), np.inf, np.float32)
            found = []
            for at in range(0, len(right), PRODUCT_ROWS):
                part = left @ right[at : at + PRODUCT_ROWS].T
                if not at:
                    # A first bound, without which all pairs of the first step would be sorted.
                    part[mine[group, None] == self.rank[None, : part.shape[1]]] = np.inf
                    edge = np.partition(part, min(self.k, part.shape[1]) - 1, axis=1)[:, : self.k].max(axis=1) if part.shape[1] >= self.k else best[:, -1]
                else:
                    edge = best[:, -1]
                q, r = np.divmod(np.flatnonzero(part <= (edge + error)[:, None]), part.shape[1])
                value = part[q, r]
                other = mine[group[q]] != self.rank[at + r]
                q, r, value = q[other], r[other] + at, value[other]
                found.append((q, r, value))
                if len(q):
                    some = np.unique(q)
                    q = np.concatenate([np.repeat(some, self.k), q])
                    value = np.concatenate([best[some].ravel(), value])
                    order = np.lexsort((value, q))
                    q, value = q[order], value[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    best[q[place < self.k], place[place < self.k]] = value[place < self.k]
            q, r, value = (np.concatenate(c) for c in zip(*found))
            near = value <= (best[:, -1] + error)[q]
            yield group, q[near], r[near]


def least_copies(rows: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that can be among any k nearest, least ids first."""
    if not rows.size:
        return np.arange(len(rows))
    same = np.ascontiguousarray(rows + 0.0)
    vector = np.unique(same.view(np.dtype((np.void, same.dtype.itemsize * same.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((rank, vector))
    vector, rank = vector[order], rank[order]
    new_vector = np.r_[True, vector[1:] != vector[:-1]]
    new_id = new_vector | np.r_[True, rank[1:] != rank[:-1]]
    number = np.cumsum(new_id)
    place = np.arange(len(order))
    ids_before = number - number[np.maximum.accumulate(np.where(new_vector, place, 0))]
    copies_before = place - np.maximum.accumulate(np.where(new_id, place, 0))
    kept = (ids_before <= k) & (copies_before < k)
    return order[kept][np.argsort(rank[kept], kind="stable")]


def squares(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of queries (columns) from rows (columns)."""
    out = np.zeros((queries.shape[1], rows.shape[1]))
    for a, b in zip(queries, rows):
        gap = b[None, :] - a[:, None]
        gap *= gap
        out += gap
    return out


def near_groups(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the sizes of its groups of at most `most`: halves at the median of the widest side, down to that size."""
    done, open_ = [], [np.arange(len(rows))]
    while open_:
        part = open_.pop()
        if len(part) <= most:
            done.append(part)
            continue
        here = rows[part]
        side = here[:, (here.max(axis=0) - here.min(axis=0)).argmax()]
        half = np.argpartition(side, len(part) // 2)
        open_ += [part[half[len(part) // 2 :]], part[half[: len(part) // 2]]]
    return np.concatenate(done), np.array([len(p) for p in done])


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, width))


def finite(vector: str = "vector") -> Column:
    """True for vectors without a null, NaN or infinite component."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def nearest(
    queries: DataFrame, reference: DataFrame, k: int = 5, skip_self: bool = False, max_bytes: int = BROADCAST_BYTES, block_rows: int | None = None
) -> DataFrame:
    """(id, neighbor, distance): the k nearest reference rows of each query row, ties by id.

    Both inputs: `id string`, `vector array<double>`. Rows whose vector is null or holds a null or non-finite
    component have no neighbours and are none. Repeated rows count each by themselves.
    """
    alike = queries is reference
    queries, reference = (df.select("id", "vector").filter(finite()) for df in (queries, reference))
    size = reference.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d"), F.sum(4 * F.coalesce(F.char_length("id"), F.lit(0))).alias("names")
    ).first()
    n, width = size["n"], size["d"] or 0
    if n * width * 8 + (size["names"] or 0) <= max_bytes:
        held = reference.toArrow().to_pandas()
        shared = queries.sparkSession.sparkContext.broadcast((held["id"].to_numpy(dtype=str), _matrix(held["vector"], width)))

        def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, rows = shared.value
            index = Index(rows, ids, k)
            for part in together(parts, width):
                own = part["id"].to_numpy(dtype=str)
                q, r, gap = index.search(_matrix(part["vector"], width), own, skip_self)
                for at in range(0, len(q), OUT_ROWS):
                    some = slice(at, at + OUT_ROWS)
                    yield pd.DataFrame({"id": own[q[some]], "neighbor": ids[r[some]], "distance": gap[some]})

        if width > TREE_WIDTH:  # every query meets all rows, so queries are dealt evenly
            queries = queries.repartition(2 * queries.sparkSession.sparkContext.defaultParallelism)
        return queries.mapInPandas(search, FOUND)
    if width > TREE_WIDTH:
        return nearest_by_tiles(None if alike else queries, reference, k, skip_self, n, width, block_rows)
    block_rows = block_rows or max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))
    blocks = Blocks(reference, n, width, k, block_rows)
    placed = cut_lineage(blocks.at_home(queries))
    first = cut_lineage(closest(blocks.search(placed.select("q", "id", "vector", F.array("home").alias("blocks")), k, skip_self), k))
    others = cut_lineage(blocks.others(placed, first, k))
    return closest(first.unionByName(blocks.search(others, k, skip_self)), k).select("id", "neighbor", "distance")


def together(parts: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Batches joined until there are queries enough that many lie near each other."""
    most, held, n = max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * max(1, width)))), [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= most:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def closest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest finds of each query `q`; tasks keep k of each before they exchange them."""
    order = Window.partitionBy("q").orderBy("distance", "neighbor")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


class Blocks:
    """Reference rows by (pivot, ring), with the row count and the least and greatest pivot distance of each.

    The driver holds at most PIVOTS vectors and PIVOTS x RINGS rows of bounds, whatever the number of rows.
    """

    def __init__(self, reference: DataFrame, n: int, width: int, k: int, block_rows: int = BLOCK_ROWS):
        self.width, self.block_rows = width, block_rows
        self.sides = width if width <= TREE_WIDTH else 0
        rows = needed(reference, k)
        wanted = max(1, min(PIVOTS, BROADCAST_BYTES // (8 * max(1, width)), -(-n // block_rows)))
        drawn = rows.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(wanted).toArrow().to_pandas()
        spark = reference.sparkSession
        pivots = spark.sparkContext.broadcast(_matrix(drawn["vector"], width))

        def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for at, gaps in to_pivots(_matrix(part["vector"], width), pivots.value):
                    cell = gaps.argmin(axis=1)
                    yield part.iloc[at : at + len(gaps)].assign(cell=cell, gap=gaps[np.arange(len(gaps)), cell])

        assigned = cut_lineage(rows.mapInPandas(assign, "id string, vector array<double>, copies int, cell int, gap double"))
        cuts = F.percentile_approx("gap", [i / RINGS for i in range(1, RINGS)], 10_000)
        cells = checked_small(assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts")))
        rings = F.least(F.lit(RINGS), F.ceil(F.col("n") / block_rows))
        before = F.size(F.filter("cuts", lambda c: c < F.col("gap")))
        block = F.col("cell") * RINGS + F.floor(before * rings / RINGS).cast("int")
        self.rows = assigned.join(cells, "cell").select("id", "vector", "copies", "gap", block.alias("block"))
        sizes = self.rows.groupBy("block").agg(
            F.count(F.lit(1)).alias("n"), F.sum("copies").alias("held"), F.min("gap").alias("low"), F.max("gap").alias("high"),
            *[f(F.col("vector")[i]).alias(f"{f.__name__}_{i}") for i in range(self.sides) for f in (F.min, F.max)],
        )
        bounds = sizes.orderBy("block").toArrow().to_pandas()  # at most PIVOTS x RINGS rows
        self.sizes = spark.createDataFrame(bounds[["block", "n"]], "block int, n bigint")
        self.held = spark.sparkContext.broadcast((pivots.value, bounds, 4 * (k + 1)))

    def at_home(self, queries: DataFrame) -> DataFrame:
        """Queries with a number `q` and the block to search first: of those with rows enough, that whose farthest row is nearest."""
        held, width = self.held, self.width

        def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, bounds, enough = held.value
            block, high = bounds["block"].to_numpy(), bounds["high"].to_numpy()
            high = np.where((bounds["held"] >= enough) | (bounds["held"].max() < enough), high, np.inf)
            for part in parts:
                for at, gaps in to_pivots(_matrix(part["vector"], width), pivots, len(block)):
                    yield part.iloc[at : at + len(gaps)].assign(home=block[(gaps[:, block // RINGS] + high).argmin(axis=1)])

        numbered = queries.select(F.monotonically_increasing_id().alias("q"), "id", "vector")
        return numbered.mapInPandas(place, "q bigint, id string, vector array<double>, home int")

    def others(self, placed: DataFrame, first: DataFrame, k: int) -> DataFrame:
        """Queries with the other blocks that can hold a row no farther than the k-th found at home."""
        held, width, sides = self.held, self.width, self.sides
        edge = F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf")))
        edges = first.groupBy("q").agg(edge.alias("edge"))

        def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, bounds, _ = held.value
            block, low, high = (bounds[c].to_numpy() for c in ("block", "low", "high"))
            for part in parts:
                for at, gaps in to_pivots(_matrix(part["vector"], width), pivots, len(block)):
                    here = part.iloc[at : at + len(gaps)]
                    near = gaps[:, block // RINGS]
                    with np.errstate(invalid="ignore"):
                        least = np.maximum(near - high, low - near) - SLACK * (near + high)
                    far = least > here["edge"].to_numpy()[:, None]
                    if sides:
                        inside = _matrix(here["vector"], width)
                        box = squares_to_boxes(inside, bounds, sides)
                        far |= np.sqrt(box) * (1 - SLACK) > here["edge"].to_numpy()[:, None]
                    far |= block[None, :] == here["home"].to_numpy()[:, None]
                    yield here[["q", "id", "vector"]].assign(blocks=[block[~line] for line in far])

        joined = placed.join(edges, "q", "left").withColumn("edge", F.coalesce("edge", F.lit(float("inf"))))
        return joined.mapInPandas(choose, "q bigint, id string, vector array<double>, blocks array<int>").filter(F.size("blocks") > 0)

    def search(self, visits: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """(q, id, neighbor, distance): up to k finds of each query in each part of the blocks it visits.

        A block with many rows or visitors is cut into parts of at most about `block_rows` on both sides.
        """
        width, most = self.width, self.block_rows
        one = visits.select("q", "id", "vector", F.explode("blocks").alias("block"))
        visitors = one.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
        cut = self.sizes.join(visitors, "block").select("block", F.ceil(F.col("n") / most).alias("of"), F.ceil(F.col("m") / most).alias("by"))
        cut = checked_small(cut)

        def each(count: str) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

        left = one.join(cut, "block").select("q", "id", "vector", "block", F.pmod(F.xxhash64("q"), F.col("by")).alias("v"), each("of").alias("r"))
        right = self.rows.join(cut, "block").select(
            "id", "vector", "copies", "block", F.pmod(F.xxhash64("id", "vector"), F.col("of")).alias("r"), each("by").alias("v")
        )

        def in_part(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            b = b.loc[b.index.repeat(b["copies"])]
            own, ids = a["id"].to_numpy(dtype=str), b["id"].to_numpy(dtype=str)
            q, r, gap = Index(_matrix(b["vector"], width), ids, k).search(_matrix(a["vector"], width), own, skip_self)
            return pd.DataFrame({"q": a["q"].to_numpy()[q], "id": own[q], "neighbor": ids[r], "distance": gap})

        keys = ["block", "v", "r"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(in_part, "q bigint, " + FOUND)


def squares_to_boxes(rows: np.ndarray, bounds: pd.DataFrame, sides: int) -> np.ndarray:
    """Squared distance of each row from each block's box."""
    out = np.zeros((len(rows), len(bounds)))
    with np.errstate(over="ignore"):
        for i in range(sides):
            low, high = bounds[f"min_{i}"].to_numpy()[None, :], bounds[f"max_{i}"].to_numpy()[None, :]
            out += np.maximum(0, np.maximum(low - rows[:, i, None], rows[:, i, None] - high)) ** 2
    return out


def needed(reference: DataFrame, k: int) -> DataFrame:
    """Reference rows that can be among any k nearest: of equal vectors the k + 1 least ids, each at most k times."""
    counted = reference.groupBy("vector", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return counted.withColumn("place", place).filter(F.col("place") <= k + 1).select("id", "vector", "copies")


def to_pivots(rows: np.ndarray, pivots: np.ndarray, beside: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all pivots) in steps that, with `beside` more cells a row, stay small."""
    step = max(1, WORK_CELLS // max(1, pivots.size, beside))
    for at in range(0, len(rows), step):
        yield at, distances(rows[at : at + step], pivots)


def knn_classify(queries: DataFrame, reference: DataFrame, k: int = 5, skip_self: bool = False, **limits) -> DataFrame:
    """The most frequent label among the k nearest; the smallest label wins ties.

    `reference` also carries `label`.
    """
    labels = checked_small(reference.select(F.col("id").alias("neighbor"), "label"))
    found = nearest(queries, reference, k, skip_self, **limits).join(labels, "neighbor")
    kind = reference.schema["label"].dataType
    said = [r["label"] for r in reference.select("label").distinct().limit(MOST_LABELS + 1).collect()] if isinstance(kind, AtomicType) else []
    if 0 < len(said) <= MOST_LABELS:  # one count for each label, so that an id is one row before rows are exchanged
        votes = found.groupBy("id").agg(*(F.count(F.when(F.col("label").eqNullSafe(F.lit(x).cast(kind)), 1)).alias(f"n{i}") for i, x in enumerate(said)))
        each = [F.when(F.col(f"n{i}") > 0, F.struct((-F.col(f"n{i}")).alias("v"), F.lit(x).cast(kind).alias("label"))) for i, x in enumerate(said)]
        return votes.select("id", F.array_min(F.array(*each))["label"].alias("predicted_label"))
    votes = found.groupBy("id", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("best"))
    return best.select("id", F.col("best.label").alias("predicted_label"))


def smote(df: DataFrame, features: list[str], minority: str, ratio: float = 0.5, k: int = 5, seed: int = 42, **limits) -> DataFrame:
    """Synthetic minority rows until the minority is `ratio` of all other rows.

    Each lies between a minority row and one of its k nearest minority rows. Rows share
    the number to make evenly; those first in shuffle order make one more.
    Input: row_id, label, features. Output: row_id, label, features of the new rows.
    """
    few = df.filter(F.col("label") == minority)
    sizes = df.agg(
        F.count(F.when(F.col("label") == minority, 1)).alias("few"), F.count(F.when(F.col("label") != minority, 1)).alias("many")
    ).first()
    wanted = int(sizes["many"] * ratio) - sizes["few"]
    points = few.select(F.col("row_id").alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("vector"))
    if wanted <= 0 or sizes["few"] < 2:
        return few.limit(0).select("row_id", "label", *features)
    each, more = divmod(wanted, sizes["few"])
    key = F.concat(hash_order(F.col("row_id"), seed), F.lit("|"), F.col("row_id"))
    cuts = quota_cuts(few, [], key, F.substring(hash_order(F.col("row_id"), seed), 1, 4), {"q": lambda n: F.lit(more).cast("bigint")})
    copies = F.lit(each) + F.when(within_cut("q", key), 1).otherwise(0)
    plan = few.crossJoin(F.broadcast(cuts)).select(F.col("row_id").alias("id"), copies.alias("copies"))  # one row

    near = nearest(points, points, k, True, **limits)
    order = F.array_sort(F.collect_list(F.struct("distance", "neighbor")))  # at most k
    found = near.groupBy("id").agg(F.transform(order, lambda s: s["neighbor"]).alias("neighbors"))
    made = plan.filter("copies > 0").join(found, "id").select(
        "id", "neighbors", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    )
    new_id = F.concat_ws("-", F.lit("smote"), "id", F.col("copy").cast("string"))
    made = made.withColumn("row_id", new_id)
    chosen = F.col("neighbors")[F.floor(hash_unit(F.col("row_id"), f"{seed}n") * F.size("neighbors")).cast("int")]
    made = made.select("row_id", "id", chosen.alias("other"), hash_unit(F.col("row_id"), f"{seed}u").alias("u"))
    a = points.select("id", F.col("vector").alias("a"))
    b = points.select(F.col("id").alias("other"), F.col("vector").alias("b"))
    both = made.join(a, "id").join(b, "other")
    return both.select(
        "row_id", F.lit(minority).alias("label"), *[(F.col("a")[i] + F.col("u") * (F.col("b")[i] - F.col("a")[i])).alias(c) for i, c in enumerate(features)]
    )
