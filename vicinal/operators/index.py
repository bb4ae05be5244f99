"""Approximate nearest-neighbour index: one graph per shard, stored as Parquet.

Layout below the index path: ``nodes/gen=N`` (a row per shard: ids, vectors and links, packed, and its beam),
``deleted/gen=N`` (row_id, upto) and ``meta/gen=N`` (one JSON row; the latest holds). Every
change adds files and a new ``meta`` row, so a failed writer leaves the index as it was.

A search reads the shards where they lie, with no exchange; only the k best of each come together.
However many inserts and deletes there were, it is one scan of nodes and one of tombstones, and
small generations are merged when they are more than ``MOST_SMALL``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.errors import DIMS_REQUIRED, INSERT_FAILED, SEARCH_FAILED, WRONG_DIMENSIONS, IndexDataError, IndexOptionError
from vicinal.functions.distance import METRICS, vector_column
from vicinal.operators.exact import exact_rows, query_blocks
from vicinal.operators.graph import ShardGraph
from vicinal.sources import stored

_NODES = "shard int, row_ids binary, vectors binary, degrees binary, links binary, beam int"
_FOUND = ["query_id", "row_id", "distance", "edge", "gen"]
#: Generations with less than a full shard that may be there before they are merged.
MOST_SMALL = 16
#: Finds of a beam that one Arrow batch brings from a worker, unless one query has more.
BATCH_FINDS = 1 << 18
#: Bytes of shards that one Arrow batch takes to a worker, unless one shard is larger.
BATCH_BYTES = 64 << 20
#: Tasks of a search for each core, and queries that a task of a shard has at least where several share it.
TASKS_PER_CORE, LEAST_ASKED = 4, 128


@dataclass(frozen=True)
class IndexOptions:
    """``dims`` is needed; ``m`` links per new node; beam widths for inserts and searches.

    ``efsearch`` is the least beam. What it finds falls with the rows of a shard and the dimensions that they
    fill, so each new shard is tried on 64 of its rows, left out meanwhile, and the beam is widened until it finds
    the share ``recall`` of their ten nearest. With 0 it is held to ``efsearch``.
    """

    dims: int = 0
    m: int = 100
    efconstruction: int = 16
    efsearch: int = 64
    metric: str = "l2"
    shard_rows: int = 20_000
    recall: float = 0.98

    def __post_init__(self):
        if not self.dims:
            raise IndexOptionError(DIMS_REQUIRED)
        for name in ("dims", "m", "efconstruction", "efsearch", "shard_rows"):
            if getattr(self, name) < 1:
                raise IndexOptionError(f"{name} must be 1 or more")
        if not 0 <= self.recall <= 1:
            raise IndexOptionError("recall must be from 0 to 1")
        if self.metric not in METRICS:
            raise IndexOptionError(f"unsupported metric {self.metric!r}")


@dataclass(frozen=True)
class _Meta:
    options: IndexOptions
    generation: int = 0
    shards: int = 0
    rows: int = 0
    largest: int = 0
    beam: int = 0  # that of the shard which needs the widest
    nodes: dict[str, int] = field(default_factory=dict)  # rows by generation
    deleted: list[int] = field(default_factory=list)


class AnnIndex:
    """Build, load, search and maintain an index. Null vectors are not indexed; a wrong length is an error."""

    def __init__(self, spark: SparkSession, path: str, meta: _Meta):
        self.spark, self.path, self._meta = spark, path.rstrip("/"), meta

    @property
    def options(self) -> IndexOptions:
        return self._meta.options

    # -- life cycle ---------------------------------------------------------------------
    @classmethod
    def build(cls, df: DataFrame, path: str, *, id_column: str, column: str, **options) -> AnnIndex:
        """Index ``df``. Rows are dealt to shards by a hash of their id, one graph is built per shard."""
        index = cls(df.sparkSession, path, _Meta(IndexOptions(**options)))
        index._append(df, id_column, column)
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AnnIndex:
        """Open a stored index."""
        rows = spark.read.text(f"{path.rstrip('/')}/meta/*").select("value").collect()
        found = [json.loads(row.value) for row in rows]
        if not found:
            raise IndexDataError(f"no index at {path}")
        last = max(found, key=lambda m: m["generation"])
        return cls(spark, path, _Meta(**{**last, "options": IndexOptions(**last["options"])}))

    def _commit(self, meta: _Meta) -> None:
        row = self.spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string")
        row.coalesce(1).write.mode("errorifexists").text(f"{self.path}/meta/gen={meta.generation}")
        self._meta = meta

    def _append(self, df: DataFrame, id_column: str, column: str) -> None:
        options, first, generation = self.options, self._meta.shards, self._meta.generation + 1
        rows = df.select(F.col(id_column).cast("long").alias("row_id"), vector_column(df, column).alias("embedding"))
        wrong = F.raise_error(F.format_string(WRONG_DIMENSIONS, F.size("embedding"), F.lit(options.dims)))
        hole = F.raise_error(F.lit("a vector has a null element"))
        rows = rows.filter(F.col("embedding").isNotNull()).withColumn(
            "embedding",
            F.when(F.size("embedding") != options.dims, wrong.cast("array<float>"))
            .when(F.exists("embedding", lambda x: x.isNull()), hole.cast("array<float>"))
            .otherwise(F.col("embedding")),
        )
        count = rows.count()
        shards = max(1, -(-count // options.shard_rows))

        def graph_of(key, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("row_id", kind="stable")
            vectors = np.array(part.embedding.tolist(), dtype=np.float32).reshape(len(part), -1)
            try:
                graph = ShardGraph(vectors.astype(np.float64), options.metric, options.m, options.efconstruction)
                beam = graph.beam_for(options.recall) if options.recall else 0
            except Exception as error:
                raise RuntimeError(INSERT_FAILED) from error
            packed = [part.row_id.to_numpy(np.int64), vectors, *(x.astype(np.int32) for x in graph.packed())]
            return pd.DataFrame([[int(key[0]), *(x.tobytes() for x in packed), beam]], columns=["shard", "row_ids", "vectors", "degrees", "links", "beam"])

        placed = rows.withColumn("shard", (F.pmod(F.xxhash64("row_id"), F.lit(shards)) + first).cast("int"))
        nodes = placed.repartition(shards, "shard").groupBy("shard").applyInPandas(graph_of, _NODES)  # a stated number of tasks is not made fewer
        nodes.write.parquet(f"{self.path}/nodes/gen={generation}")
        largest, beam = (x or 0 for x in self._read_nodes([generation]).agg(F.max(F.length("row_ids") / 8), F.max("beam")).first())
        self._commit(
            replace(
                self._meta,
                generation=generation,
                shards=first + shards,
                rows=self._meta.rows + count,
                largest=max(self._meta.largest, int(largest)),
                beam=max(self._meta.beam, int(beam)),
                nodes={**self._meta.nodes, str(generation): count},
            )
        )

    def insert(self, df: DataFrame, *, id_column: str, column: str) -> None:
        """Add rows as new shards."""
        self._append(df, id_column, column)
        small = [int(g) for g, n in self._meta.nodes.items() if n < self.options.shard_rows]
        if len(small) > MOST_SMALL:
            self._merge(small)

    def _merge(self, generations: Sequence[int]) -> None:
        """Put the live rows of some generations into one; their files stay for searches under way."""
        live = self._alive(self._spread(self._read_nodes(generations))).select("row_id", "embedding")
        kept = {g: n for g, n in self._meta.nodes.items() if int(g) not in generations}
        fresh = AnnIndex(self.spark, self.path, replace(self._meta, nodes=kept, rows=sum(kept.values())))
        fresh._append(live, "row_id", "embedding")
        self._meta = fresh._meta

    def delete(self, ids: DataFrame, id_column: str) -> None:
        """Mark rows as deleted. Their nodes stay in the graph as stepping stones until ``compact``."""
        generation = self._meta.generation + 1
        dead = ids.select(F.col(id_column).cast("long").alias("row_id"), F.lit(self._meta.generation).cast("int").alias("upto"))
        dead.write.parquet(f"{self.path}/deleted/gen={generation}")
        self._commit(replace(self._meta, generation=generation, deleted=[*self._meta.deleted, generation]))

    def truncate(self) -> None:
        """Forget all rows; the options stay."""
        self._commit(_Meta(self.options, generation=self._meta.generation + 1))

    def alter(self, **options) -> None:
        """Change beam widths. Other options are fixed by the stored graph."""
        if fixed := set(options) - {"efconstruction", "efsearch"}:
            raise IndexOptionError(
                "Inconsistency with HNSW index metadata: only ef_construction and ef_search options may be"
                f" changed, not {', '.join(sorted(fixed))}"
            )
        changed = replace(self.options, **options)
        self._commit(replace(self._meta, options=changed, generation=self._meta.generation + 1))

    def compact(self) -> None:
        """Rebuild from the live rows, without the deleted ones and with full shards."""
        live = self.rows().select("row_id", "embedding")
        fresh = AnnIndex(self.spark, self.path, _Meta(self.options, generation=self._meta.generation))
        fresh._append(live, "row_id", "embedding")
        self._meta = fresh._meta

    def drop(self) -> None:
        """Delete the stored index."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    # -- reading ------------------------------------------------------------------------
    def _read_nodes(self, generations: Sequence[int]) -> DataFrame:
        """The shards of some generations, one scan, with the generation of each."""
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        if int(str(self.spark.conf.get(name)).rstrip("bB") or 0) > BATCH_BYTES:
            self.spark.conf.set(name, BATCH_BYTES)
        if not generations:
            return self.spark.createDataFrame([], f"{_NODES}, gen int")
        paths = [f"{self.path}/nodes/gen={g}" for g in generations]
        return self.spark.read.schema(f"{_NODES}, gen int").option("basePath", f"{self.path}/nodes").parquet(*paths)

    def _spread(self, nodes: DataFrame) -> DataFrame:
        """``row_id, embedding, gen`` of every row of the shards."""
        dims = self.options.dims

        def rows(batches):
            for batch in batches:
                for gen, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("gen", "row_ids", "vectors")), strict=True):
                    own = pa.array(np.frombuffer(ids, np.int64))
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * dims), pa.array(np.frombuffer(vectors, np.float32)))
                    yield pa.RecordBatch.from_arrays([own, listed, pa.array(np.full(len(own), gen, np.int32))], names=["row_id", "embedding", "gen"])

        return nodes.mapInArrow(rows, "row_id long, embedding array<float>, gen int")

    def _alive(self, found: DataFrame) -> DataFrame:
        """Rows without a tombstone that is later than they are; one join, however many deletes there were."""
        if not self._meta.deleted:
            return found
        paths = [f"{self.path}/deleted/gen={g}" for g in self._meta.deleted]
        dead = self.spark.read.schema("row_id long, upto int").parquet(*paths).groupBy(F.col("row_id").alias("dead_id")).agg(F.max("upto").alias("upto"))
        return found.join(dead, (F.col("row_id") == F.col("dead_id")) & (F.col("gen") <= F.col("upto")), "left_anti")

    def rows(self) -> DataFrame:
        """The live rows: row_id, embedding."""
        return self._alive(self._spread(self._read_nodes([*map(int, self._meta.nodes)]))).select("row_id", "embedding")

    def count(self) -> int:
        return self.rows().count()

    def _shards(self) -> int:
        return sum(max(1, -(-n // self.options.shard_rows)) for n in self._meta.nodes.values()) or 1

    # -- search -------------------------------------------------------------------------
    def search(
        self,
        queries: DataFrame | Sequence[float] | None,
        k: int | None = None,
        *,
        ef: int | None = None,
        query_id: str = "query_id",
        query_vector: str = "query",
        allowed: DataFrame | None = None,
        allowed_id: str = "row_id",
    ) -> DataFrame:
        """``query_id, row_id, distance, rank`` by distance, ties by row id.

        ``queries`` is one vector or a table of them. Every shard is searched with the beam ``ef`` (if not
        given, ``efsearch`` or what the shards need), which is twice k or more. Where rows are deleted or only those
        in ``allowed`` count, half a beam is taken, as its farther half has gaps, and doubled for the queries
        that have fewer than k rows nearer than where the half of any shard ends, until it is the whole shard. The
        first beam is as wide as the share of the rows in ``allowed`` lets expect.
        A null query finds nothing.
        """
        if queries is None:
            return self._empty()
        if not isinstance(queries, DataFrame):
            queries = self.spark.createDataFrame([(0, [float(x) for x in queries])], "query_id long, query array<float>")
            query_id, query_vector = "query_id", "query"
        allowed = None if allowed is None else allowed.select(F.col(allowed_id).cast("long").alias("row_id")).distinct()
        blocks = []
        for ids, vectors in query_blocks(queries, query_id, query_vector):
            if vectors.shape[1] != self.options.dims:
                raise ValueError(WRONG_DIMENSIONS % (vectors.shape[1], self.options.dims))
            blocks.append((ids, vectors))
        least = ef or self.options.efsearch
        wide = least  # shards that need more have a beam of their own, unless ef is given
        total = self._empty().select("query_id", "row_id", "distance")
        plain = allowed is None and not self._meta.deleted  # the k nearest of each shard are enough
        depth = None if k is None else k if plain else max(k, least // 2)
        if k is not None and allowed is not None and blocks and wide < self._meta.largest:  # about as many as hold k that count, with some to spare, so that few queries need another round
            depth = max(depth, self._depth_for(k, allowed.count()))
        while blocks:
            wide = wide if k is None else max(wide, 2 * depth)
            last = plain or k is None or wide >= self._meta.largest
            found = None
            for ids, vectors in blocks:
                reached = self._beam(ids, vectors, wide, depth if plain or not last else None, edges=not last, widen=ef is None)
                found = reached if found is None else found.unionByName(reached)
            if allowed is not None:
                found = found.join(allowed.withColumn("counts", F.lit(True)), "row_id", "left").filter("counts or edge")
            if last:
                total = total.unionByName(found.select("query_id", "row_id", "distance"))
                break
            found = stored(found.select("query_id", "row_id", "distance", "edge"), "beam")
            edges = found.filter("edge").groupBy("query_id").agg(F.min("distance").alias("upto"))
            found = found.filter("not edge").drop("edge")
            full = found.join(edges, "query_id").filter("distance < upto").groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
            done = {row.query_id for row in full.toLocalIterator()}  # as many as there are stated queries, at most
            total = total.unionByName(found.join(full, "query_id", "left_semi"))
            short = [np.array([name not in done for name in ids], dtype=bool) for ids, _ in blocks]
            blocks = [([n for n, s in zip(ids, some, strict=True) if s], vectors[some]) for (ids, vectors), some in zip(blocks, short, strict=True) if some.any()]
            depth *= 2
        by = Window.partitionBy("query_id").orderBy("distance", "row_id")
        ranked = total.select("query_id", "row_id", "distance").withColumn("rank", F.row_number().over(by))
        return ranked if k is None else ranked.filter(F.col("rank") <= k)

    def _depth_for(self, k: int, counting: int) -> int:
        """Nodes of each shard among which k of so many that count may be expected, twice over; all are the most."""
        share = k * self._meta.rows / (max(1, counting) * self._shards())
        return min(self._meta.largest, 2 * math.ceil(share) + 8 * math.ceil(math.sqrt(share)))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "query_id long, row_id long, distance double, rank int")

    def _beam(self, ids: list, vectors: np.ndarray, ef: int, depth: int | None = None, edges: bool = False, widen: bool = False) -> DataFrame:
        """The nodes that a beam of every query reaches in every shard, deleted ones left out: all, or the nearest, so many as ``depth``.

        With ``widen``, the beam is that which the shard needs, where it is wider. With ``edges``, a row for each query and shard tells the distance from which on nodes may have been left out.
        """
        options, shared = self.options, self.spark.sparkContext.broadcast((ids, vectors))
        # fewer shards than cores would leave cores idle: each shard is read by so many tasks, with a part of the queries each
        parts = max(1, min(-(-TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism // self._shards()), len(ids) // LEAST_ASKED))

        def look(batches, part=0):
            for batch in batches:
                for gen, beam, *packed in zip(*(batch.column(c).to_pylist() for c in ("gen", "beam", "row_ids", "vectors", "degrees", "links")), strict=True):
                    width = max(ef, beam) if widen else ef
                    rows, have, degrees, links = (np.frombuffer(x, kind) for x, kind in zip(packed, (np.int64, np.float32, np.int32, np.int32), strict=True))
                    if len(have) != len(rows) * options.dims:
                        raise IndexDataError(WRONG_DIMENSIONS % (len(have) // max(1, len(rows)), options.dims))
                    have = have.astype(np.float64).reshape(len(rows), -1)
                    try:
                        graph = ShardGraph(have, options.metric, options.m, options.efconstruction, (degrees, links))
                    except Exception as error:
                        raise RuntimeError(SEARCH_FAILED) from error
                    first, end = (len(shared.value[0]) * x // parts for x in (part, part + 1))
                    step = max(1, BATCH_FINDS // min(len(rows), width, depth or width))
                    for begin in range(first, end, step):
                        own = slice(begin, min(begin + step, end))
                        names, wanted = np.array(shared.value[0][own], dtype=np.int64), shared.value[1][own]
                        try:
                            reached = graph.search_all(wanted, width, None if depth is None else depth + 1)  # one more tells whether any are left out
                        except Exception as error:
                            raise RuntimeError(SEARCH_FAILED) from error
                        nearest, distances = [nodes[:depth] for nodes, _ in reached], [d[:depth] for _, d in reached]
                        sizes = [len(nodes) for nodes in nearest]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(names, sizes)), pa.array(rows[np.concatenate(nearest)]), pa.array(np.concatenate(distances)), pa.array(np.zeros(sum(sizes), bool)), pa.array(np.full(sum(sizes), gen, np.int32))],
                            names=_FOUND,
                        )
                        if edges:
                            ends = [d[-1] if len(d) < len(nodes) else np.inf for d, (nodes, _) in zip(distances, reached, strict=True)]
                            spread = names * 0x9E3779B97F4A7 + rows[0]  # any ids, of a generation that no tombstone is later than
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, spread, np.array(ends), np.ones(len(names), bool), np.full(len(names), 2**31 - 1, np.int32))], names=_FOUND)

        nodes = self._read_nodes([*map(int, self._meta.nodes)])
        found = None
        for part in range(parts):
            reached = nodes.mapInArrow(partial(look, part=part), "query_id long, row_id long, distance double, edge boolean, gen int")
            found = reached if found is None else found.unionByName(reached)
        return self._alive(found).select("query_id", "row_id", "distance", "edge")
