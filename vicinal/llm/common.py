"""What the text operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word: a run of letters.
WORD = re.compile(r"[^\W\d_]+")


#: Bytes of an Arrow batch; several are held at a time, by the worker and by the JVM.
BATCH_BYTES = 16 << 20
#: Rows from which a key may be dealt over several tasks of a join, the most such keys, and the tasks of each.
HOT_ROWS, HOT_KEYS, SALTS = 500, 1_000, 64


def bounded(df: DataFrame) -> DataFrame:
    """The table itself; its session hands batches of at most ``BATCH_BYTES`` to Python from now on."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d*", df.sparkSession.conf.get(name)).group() or 0) > BATCH_BYTES:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df


def rows_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, text`` of a table, whatever its other columns are called; a null text is empty."""
    return bounded(docs).select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to every batch; empty batches are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Join on a key of which ``right`` has one row and ``left`` may have very many.

    The keys with most rows, ``HOT_KEYS`` at most, have their rows dealt over ``SALTS`` tasks by
    the hash of the columns ``spread``; the row of ``right`` goes to each of these. Any other key
    has less than ``HOT_ROWS`` rows or than one in ``HOT_KEYS`` of all. ``counted`` may give the
    rows of the keys, as ``hot_key, hot_rows``, where they are known.
    """
    if counted is None:
        counted = left.groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("hot_rows"))
    many = counted.filter(F.col("hot_rows") >= HOT_ROWS)
    hot = F.broadcast(many.orderBy(F.desc("hot_rows"), "hot_key").limit(HOT_KEYS).select("hot_key"))
    dealt = left.join(hot, left[key] == F.col("hot_key"), "left").withColumn("salt", F.when(F.col("hot_key").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.lit(SALTS))).cast("int"))
    copies = F.when(F.col("hot_key").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copied = right.join(hot, right[key] == F.col("hot_key"), "left").withColumn("salt", F.explode(copies))
    return dealt.drop("hot_key").join(copied.drop("hot_key"), [key, "salt"], how).drop("salt")


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about ``most`` bytes; one longer text is a part of its own."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))])
    start = 0
    while start < batch.num_rows:
        stop = start + 1
        while stop < batch.num_rows and ends[stop + 1] - ends[start] <= most:
            stop += 1
        yield batch.slice(start, stop - start)
        start = stop


class WordCache(dict):
    """A map from words to what a function makes of them, emptied when it is full."""

    def __init__(self, function: Callable[[str], object], most: int = 100_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.function(word)
        return value


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different words (bytes) of an array of bytes or code points, and the number of each word among them.

    Words are held against each other whole, by Arrow's dictionary; ``starts`` and ``ends`` are in order.
    """
    edge = np.zeros(len(raw) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inner = raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]) * raw.itemsize
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(inner))]).dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False), words.indices.to_numpy()


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes (XXH64) of the words of an array; each different word is hashed once."""
    words, of = distinct_words(raw, starts, ends)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))[of]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true values start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]
