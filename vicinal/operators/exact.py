"""Exact search: distances as columns, top-k, range search, and the batch k-nearest join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vicinal.errors import DIFFERENT_DIMENSIONS
from vicinal.functions.distance import distance, vector, vector_column

#: Bytes of query vectors that one pass over the base table carries to the executors.
QUERY_BLOCK_BYTES = 32 << 20
#: Pairs that a task multiplies at a time, and those of them whose vectors it subtracts at a time.
TILE_PAIRS, EXACT_PAIRS = 1 << 20, 1 << 15
#: Rows that a task of a batch join looks at first; then as many as before, so that few are near enough to be subtracted.
FIRST_ROWS = 1 << 10
#: Pairs whose Manhattan distances are summed at a time: few enough for a processor's cache.
CACHED_PAIRS = 1 << 15
#: Tasks of a batch join, at least, that each send their own k best of every query; more only where there are more cores.
JOIN_TASKS = 64


def with_distance(df: DataFrame, column: str, query: Column | Sequence[float] | None, metric: str = "l2", name: str = "distance") -> DataFrame:
    """``df`` with the double distance of ``column`` to a query vector."""
    return df.withColumn(name, distance(metric, vector_column(df, column), vector(query)))


def nearest(
    df: DataFrame,
    column: str,
    query: Column | Sequence[float] | None,
    k: int | None = None,
    *,
    metric: str = "l2",
    id_column: str,
    offset: int = 0,
    descending: bool = False,
    name: str = "distance",
) -> DataFrame:
    """Rows by distance, ties by id; null vectors come last.

    With ``k`` the plan is a top-k per partition and a merge, with no full sort.
    """
    found = with_distance(df, column, query, metric, name)
    by = F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()
    found = found.orderBy(by, F.col(id_column).asc_nulls_last())
    if offset:
        found = found.offset(offset)
    return found if k is None else found.limit(k)


def range_search(df: DataFrame, column: str, query, radius: float, *, metric: str = "l2", name: str = "distance") -> DataFrame:
    """Rows whose distance is below ``radius``; null vectors do not qualify."""
    return with_distance(df, column, query, metric, name).filter(F.col(name) < radius)


def pairwise(metric: str, queries: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Keys of every query (row) and base vector (column) in the order of their distance, and how far each may be off.

    For L2 the keys are squares put together from norms and products. Where these cancel, the error
    is in proportion to the norms, not to the distance.
    """
    unit = 4 * (queries.shape[1] + 8) * np.finfo(float).eps
    if metric == "l2":
        norms = (queries**2).sum(1)[:, None] + (base**2).sum(1)
        return norms - 2 * queries @ base.T, unit * norms
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - queries @ base.T / (np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((base**2).sum(1))), unit
    if metric == "manhattan":
        return np.stack([np.abs(base - q).sum(1) for q in queries]) if len(queries) else np.zeros((0, len(base))), 0.0
    raise ValueError(f"unknown metric {metric!r}")


def exact_rows(metric: str, query: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Distances of a query, or of one query for each row, to rows: summed row by row, so equal rows have equal distances."""
    if metric == "l2":
        return np.sqrt(((base - query) ** 2).sum(-1))
    if metric == "manhattan":
        return np.abs(base - query).sum(-1)
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (base * query).sum(-1) / (np.sqrt((base**2).sum(-1)) * np.sqrt((query**2).sum(-1)))
    raise ValueError(f"unknown metric {metric!r}")


def matrix(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """A column of non-null vectors as a matrix; unequal lengths and null elements are errors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, dims or 0))
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths[0]) if dims is None else dims
    if (lengths != width).any():
        raise ValueError(DIFFERENT_DIMENSIONS % (int(lengths[lengths != width][0]), width))
    values = column.flatten()
    if values.null_count:
        raise ValueError("a vector has a null element")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def query_blocks(queries: DataFrame, id_column: str, column: str, own_bytes: int = 0) -> Iterator[tuple[list, np.ndarray]]:
    """The queries in blocks of bounded size; null vectors are left out. A task holds ``own_bytes`` besides of every query."""
    chosen = queries.select(F.col(id_column).alias("id"), vector_column(queries, column).alias("v")).filter("v is not null")
    ids: list = []
    vectors: list = []
    size = 0
    for row in chosen.toLocalIterator():
        if any(x is None for x in row.v):
            raise ValueError("a vector has a null element")
        if vectors and len(row.v) != len(vectors[0]):
            raise ValueError(DIFFERENT_DIMENSIONS % (len(row.v), len(vectors[0])))
        ids.append(row.id)
        vectors.append(np.array(row.v, dtype=np.float64))
        size += 8 * len(row.v) + 64 + own_bytes
        if size >= QUERY_BLOCK_BYTES:
            yield ids, np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
            ids, vectors, size = [], [], 0
    if ids:
        yield ids, np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)


def best_of(low: np.ndarray, gap: np.ndarray | float, k: int) -> np.ndarray:
    """Which of each row, not below ``low`` nor above ``low + gap``, may be among its k least: no k others are surely below them. NaN counts as infinite."""
    if low.shape[1] <= k:
        return np.ones(low.shape, dtype=bool)
    low = np.where(np.isnan(low), np.inf, low)
    return low <= np.partition(low + gap, k - 1, axis=1)[:, k - 1 : k]


class Bounds:
    """Lower bounds of the keys of ``pairwise`` for some base vectors and any queries, in one product or in single precision."""

    def __init__(self, metric: str, have: np.ndarray):
        self.metric, self.have, self.dims = metric, have, have.shape[1]
        self.unit = 4 * (self.dims + 8) * np.finfo(float).eps
        self.exact = True
        if metric == "l2":
            self.norms = (have**2).sum(1)
            self.table = np.concatenate([have, np.ones((len(have), 1)), self.norms[:, None] * (1 - self.unit)], axis=1).T
        elif metric == "cosine":
            self.table = self._unit(have).T
        elif metric == "manhattan":
            self.exact = not self._single(have)
            self.table = None if self.exact else np.ascontiguousarray(have.astype(np.float32).T)
        else:
            raise ValueError(f"unknown metric {metric!r}")

    @staticmethod
    def _unit(vectors: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return vectors / np.sqrt((vectors**2).sum(1))[:, None]

    @staticmethod
    def _single(vectors: np.ndarray) -> bool:
        """Whether the vectors are the same in single precision and their sums far from its ends."""
        size = np.abs(vectors)
        return bool(((size == 0) | ((size > 1e-20) & (size < 1e30))).all() and (vectors.astype(np.float32) == vectors).all())

    def of(self, part: np.ndarray):
        """Bounds of every query (row) and base vector (column), and a function: how far the keys of some rows may be above."""
        if self.metric == "l2":
            norms = (part**2).sum(1)[:, None]
            low = np.concatenate([-2 * part, norms * (1 - self.unit), np.ones_like(norms)], axis=1) @ self.table
            return low, lambda rows: 4 * self.unit * (norms[rows] + self.norms)
        if self.metric == "cosine":
            low = -self._unit(part) @ self.table
            low += 1 - self.unit
            return low, lambda rows: 4 * self.unit
        if self.table is None or not self._single(part):
            low = pairwise(self.metric, part, self.have)[0]
            return low, lambda rows: 0.0
        low, step = np.empty((len(part), len(self.have)), dtype=np.float32), max(1, CACHED_PAIRS // max(1, len(self.have)))
        columns = np.ascontiguousarray(part.astype(np.float32).T)
        for begin in range(0, len(part), step):
            total = low[begin : begin + step]
            total[:] = 0
            apart = np.empty_like(total)
            for q, b in zip(columns[:, begin : begin + step], self.table, strict=True):
                np.subtract(b, q[:, None], out=apart)
                np.abs(apart, out=apart)
                total += apart
        unit = np.float32((self.dims + 8) * np.finfo(np.float32).eps)
        low *= 1 - unit
        return low, lambda rows: 4 * unit * low[rows]


def tiles(wanted: np.ndarray, have: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The queries in parts whose pairs with ``have`` are ``TILE_PAIRS`` at most, each with the place where it begins."""
    step = max(1, TILE_PAIRS // max(1, len(have)))
    for begin in range(0, len(wanted), step):
        yield begin, wanted[begin : begin + step]


def exact_pairs(metric: str, queries: np.ndarray, base: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``exact_rows`` of the pairs of query i and base vector j, some at a time."""
    parts = [exact_rows(metric, queries[i[at : at + EXACT_PAIRS]], base[j[at : at + EXACT_PAIRS]]) for at in range(0, len(i), EXACT_PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Best:
    """The k nearest rows so far of every query, in two tables of k columns; ties go by id, NaN comes last."""

    def __init__(self, metric: str, wanted: np.ndarray, k: int):
        self.metric, self.wanted, self.k = metric, wanted, k
        self.distances, self.count = np.full((len(wanted), k), np.inf), np.zeros(len(wanted), dtype=int)
        self.ids: np.ndarray | None = None
        self.rows_seen = 0

    def add(self, ids: np.ndarray, have: np.ndarray) -> None:
        if self.ids is None:
            self.ids = np.empty(self.distances.shape, dtype=ids.dtype)
        at = 0
        while at < len(have):
            rows = slice(at, at + max(FIRST_ROWS, self.rows_seen))
            self._add(ids[rows], have[rows])
            at += len(ids[rows])
            self.rows_seen += len(ids[rows])

    def _add(self, ids: np.ndarray, have: np.ndarray) -> None:
        near = Bounds(self.metric, have)
        for begin, part in tiles(self.wanted, have):
            i, j = self._candidates(near, part, slice(begin, begin + len(part)))
            for at in range(0, len(i), TILE_PAIRS):
                self._merge(begin + i[at : at + TILE_PAIRS], exact_pairs(self.metric, part, have, i[at : at + TILE_PAIRS], j[at : at + TILE_PAIRS]), ids[j[at : at + TILE_PAIRS]])

    def _candidates(self, near: Bounds, part: np.ndarray, own: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that are not surely farther than the k that the query has. Where these are many, those that k others are not surely below."""
        worst = self.distances[own, -1]
        limit = np.where((self.count[own] < self.k) | np.isnan(worst), np.inf, worst)
        if self.metric == "l2":
            limit = limit**2 * (1 + 1e-12)
        low, gap = near.of(part)
        maybe = ~(low > limit[:, None])  # NaN may be
        many = np.flatnonzero(maybe.sum(axis=1) > 4 * self.k + 64)
        if len(many):
            maybe[many] &= best_of(low[many], gap(many), self.k)
        many = many[maybe[many].sum(axis=1) > 4 * self.k + 64]
        if len(many) and not near.exact:
            keys, slack = pairwise(self.metric, part[many], near.have)
            maybe[many] &= best_of(keys - slack, 2 * slack, self.k)
        return np.nonzero(maybe)

    def _merge(self, queries: np.ndarray, distances: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(queries)
        place = np.arange(self.k) < self.count[touched, None]
        queries = np.concatenate([queries, np.repeat(touched, self.count[touched])])
        distances = np.concatenate([distances, self.distances[touched][place]])
        ids = np.concatenate([ids, self.ids[touched][place]])
        order = np.lexsort((ids, distances, queries))
        queries = queries[order]
        starts = np.flatnonzero(np.diff(queries, prepend=-1))
        rank = np.arange(len(queries)) - np.repeat(starts, np.diff(starts, append=len(queries)))
        kept = rank < self.k
        self.distances[queries[kept], rank[kept]] = distances[order][kept]
        self.ids[queries[kept], rank[kept]] = ids[order][kept]
        self.count[touched] = np.minimum(self.k, np.diff(starts, append=len(queries)))

    def rows(self, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of queries, ids and distances, about ``step`` rows at a time."""
        step = max(1, step // self.k)
        for begin in range(0, len(self.wanted) if self.ids is not None else 0, step):
            place = np.arange(self.k) < self.count[begin : begin + step, None]
            yield begin + np.nonzero(place)[0], self.ids[begin : begin + step][place], self.distances[begin : begin + step][place]


def near_join(base: DataFrame, queries: DataFrame, radius: float, *, metric: str = "l2", base_id: str, base_vector: str, query_id: str, query_vector: str) -> DataFrame:
    """``query_id, base_id, distance`` of all pairs closer than ``radius``; stated queries in blocks, each against all rows.

    Pairs that are surely too far by products are left out, all others are computed by differences.
    """
    spark = base.sparkSession
    q_type, b_type = queries.schema[query_id].dataType.simpleString(), base.schema[base_id].dataType.simpleString()
    q_arrow = to_arrow_type(queries.schema[query_id].dataType)
    schema = f"query_id {q_type}, base_id {b_type}, distance double"
    rows = base.select(F.col(base_id).alias("id"), vector_column(base, base_vector).alias("v")).filter("v is not null")
    found = spark.createDataFrame([], schema)
    limit = radius**2 if metric == "l2" else radius
    for ids, vectors in query_blocks(queries, query_id, query_vector):
        shared = spark.sparkContext.broadcast((ids, vectors))

        def near(batches, shared=shared):
            names, wanted = shared.value
            for batch in batches:
                have = matrix(batch.column("v"), wanted.shape[1])
                for begin, part in tiles(wanted, have):
                    keys, slack = pairwise(metric, part, have)
                    pairs = np.nonzero(keys - slack < limit)
                    for at in range(0, len(pairs[0]), EXACT_PAIRS):
                        i, j = (x[at : at + EXACT_PAIRS] for x in pairs)
                        d = exact_rows(metric, part[i], have[j])
                        close = np.flatnonzero(d < radius)
                        own = [names[begin + x] for x in i[close].tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(own, q_arrow), batch.column("id").take(pa.array(j[close])), pa.array(d[close])], names=["query_id", "base_id", "distance"])

        found = found.unionByName(rows.mapInArrow(near, schema))
    return found


def knn_join(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    metric: str = "l2",
    base_id: str,
    base_vector: str,
    query_id: str,
    query_vector: str,
) -> DataFrame:
    """The k nearest base rows of every query: ``query_id, base_id, distance, rank``.

    The stated queries travel to the base partitions in blocks of ``QUERY_BLOCK_BYTES``. A task keeps
    the k best of every query while its rows pass, and multiplies ``TILE_PAIRS`` pairs at a time, so its
    memory is that of a block however many queries and rows there are. Every pair is looked at, so time
    is in proportion to queries by rows. Null vectors of either side take no part. Ties go by base id.
    """
    spark = base.sparkSession
    q_type, b_type = queries.schema[query_id].dataType.simpleString(), base.schema[base_id].dataType.simpleString()
    q_arrow, b_arrow = (to_arrow_type(df.schema[c].dataType) for df, c in ((queries, query_id), (base, base_id)))
    schema = f"query_id {q_type}, base_id {b_type}, distance double"
    rows = base.select(F.col(base_id).alias("id"), vector_column(base, base_vector).alias("v")).filter("v is not null")
    rows = rows.coalesce(max(JOIN_TASKS, 2 * spark.sparkContext.defaultParallelism))
    found = spark.createDataFrame([], schema)
    for ids, vectors in query_blocks(queries, query_id, query_vector, 16 * k):
        shared = spark.sparkContext.broadcast((ids, vectors))

        def search(batches, shared=shared):
            names, wanted = shared.value
            best = Best(metric, wanted, k)
            for batch in batches:
                own = batch.column("id").to_pylist()
                own = np.array(own, dtype=np.int64 if pa.types.is_integer(b_arrow) and None not in own else object)
                best.add(own, matrix(batch.column("v"), wanted.shape[1]))
            for numbers, near, d in best.rows():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[x] for x in numbers.tolist()], q_arrow), pa.array(near.tolist(), b_arrow), pa.array(d)],
                    names=["query_id", "base_id", "distance"],
                )

        found = found.unionByName(rows.mapInArrow(search, schema))
    ranked = Window.partitionBy("query_id").orderBy("distance", "base_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
