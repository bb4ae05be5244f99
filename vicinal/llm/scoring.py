"""Cross-entropy difference: two n-gram models over one vocabulary score every document.

The vocabulary is that of a byte-level tokenizer, whose size bounds it. Target and background
model are bigram models of equal make (Witten-Bell back-off to add-one unigrams), counted over
all target documents and over all documents. The score of a document is the mean over its
tokens of background loss minus target loss; above 0 it looks more like the target.

Counting sums up inside each task before anything is shuffled. The losses of the most frequent
bigrams, ``HOT`` at most, are broadcast and looked up in one pass over the ids; what that pass
does not find, rare bigrams by construction, is joined by key, so no broadcast grows with the
input and no key of the join is hot. Null and empty texts have no tokens and score 0; repeated rows count and score
each; without target documents the target model is uniform; an empty table gives an empty one;
rows of null id are background; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.bpe import codec
from vicinal.llm.common import map_arrow, rows_of, slices
from vicinal.sources import stored

#: Entries of the table of losses that are broadcast, 12 bytes each.
HOT = 12_000_000
#: Entries that a counting task holds before it hands them on.
HELD = 3_000_000


def _tokenized(rows: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        coder = codec(rank_file, pattern)
        for part in slices(batch, "text"):
            ids = [coder.encode(t) for t in part.column("text").to_pylist()]
            width = np.uint16 if all(len(x) == 0 or x.max() < 1 << 16 for x in ids) else np.uint32
            if width is not np.uint16:
                raise ValueError("the vocabulary is larger than 65,536")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    return map_arrow(rows, run, f"doc_id {kind}, ids binary")


def _bigrams(packed: list[bytes], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``before * 65536 + token`` of all tokens, and the number of tokens of each document."""
    sizes = np.array([len(p) // 2 for p in packed])
    ids = np.frombuffer(b"".join(packed), "<u2").astype(np.uint32)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, int)
    before[starts[sizes > 0]] = begin
    return before << np.uint32(16) | ids, sizes


def _counted(marked: DataFrame, begin: int) -> DataFrame:
    """``key, n, t``: partial counts of bigrams in all and in target documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys = np.concatenate([h[0] for h in held])
            known, at = np.unique(keys, return_inverse=True)
            sums = [np.bincount(at, weights=np.concatenate([h[i] for h in held]), minlength=len(known)).astype(np.int64) for i in (1, 2)]
            return known, *sums

        def emit():
            keys, n, t = held[0]
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n), pa.array(t)], names=["key", "n", "t"])

        for batch in batches:
            for part in slices(batch, "ids", 4 << 20) if batch.num_rows else ():
                keys, sizes = _bigrams(part.column("ids").to_pylist(), begin)
                target = np.repeat(part.column("target").to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                known, at, n = np.unique(keys, return_inverse=True, return_counts=True)
                held.append((known, n, np.bincount(at, weights=target, minlength=len(known)).astype(np.int64)))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield emit()
                        held = []
        if held:
            held = [merged()]
            yield emit()

    return marked.mapInArrow(run, "key long, n long, t long")


def losses(docs: DataFrame, target_ids: DataFrame, rank_file: str, pattern: str, vocabulary: int, *, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The tokenized documents, and ``key, n, background, target``: count and minus log probabilities of all bigrams."""
    tokens = stored(_tokenized(rows_of(docs, id_column, text_column), rank_file, pattern), "lm-tokens")
    chosen = target_ids.select(target_ids[id_column].alias("chosen")).filter("chosen is not null").distinct()
    # the same plan at every size: without the hint a small table of ids is broadcast, a large one is not
    marked = tokens.join(chosen.hint("merge"), F.col("doc_id") == F.col("chosen"), "left").select("ids", F.col("chosen").isNotNull().alias("target"))
    counts = _counted(marked, vocabulary).groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counts = counts.select("key", F.shiftright("key", 16).alias("v"), F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("w"), "n", "t")
    counts = stored(counts, "lm-counts")
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    contexts = counts.groupBy("v").agg(F.sum("n").alias("vn"), F.sum("t").alias("vt"), seen("n").alias("kn"), seen("t").alias("kt"))
    words = counts.groupBy("w").agg(F.sum("n").alias("wn"), F.sum("t").alias("wt"))
    total = words.agg(F.coalesce(F.sum("wn"), F.lit(0)), F.coalesce(F.sum("wt"), F.lit(0))).first()

    def loss(c: str, all_tokens: int):
        unigram = (F.col(f"w{c}") + 1) / F.lit(float(all_tokens + vocabulary))
        known = F.col(f"v{c}") + F.col(f"k{c}")
        return -F.log(F.when(known == 0, unigram).otherwise((F.col(c) + F.col(f"k{c}") * unigram) / known))

    # contexts and words have a row per vocabulary entry at most
    table = counts.join(F.broadcast(contexts), "v").join(F.broadcast(words), "w")
    return tokens, table.select("key", "n", loss("n", total[0]).cast("float").alias("background"), loss("t", total[1]).cast("float").alias("target"))


def _cut(table: DataFrame, most: int) -> int:
    """The power of two from which on bigrams are frequent: the least that ``most`` entries at most reach; 1 if all are."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = table.groupBy(level.alias("level")).count().collect()  # 63 rows at most
    held = 0
    for size in sorted(sizes, reverse=True):
        held += size["count"]
        if held > most:
            return 1 << size["level"] + 1
    return 1


def _looked_up(tokens: DataFrame, table: DataFrame, vocabulary: int, whole: bool) -> DataFrame:
    """``doc_id, n_tokens, target, background``: sums of the losses in ``table``, which is broadcast.

    Unless the table is ``whole`` there are also ``row`` and ``cold``, the bigrams it lacks and how often they occur.
    """
    got = table.select("key", "background", "target").toArrow()
    keys = got.column("key").to_numpy().astype(np.uint32)
    order = np.argsort(keys)
    shared = tokens.sparkSession.sparkContext.broadcast((keys[order], got.column("background").to_numpy()[order], got.column("target").to_numpy()[order]))
    schema = f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, n_tokens long, target double, background double"

    def run(batch: pa.RecordBatch):
        known, background, target = shared.value
        for part in slices(batch, "ids", 4 << 20):
            keys, sizes = _bigrams(part.column("ids").to_pylist(), vocabulary)
            of = np.repeat(np.arange(len(sizes)), sizes)
            distinct, at = np.unique(keys, return_inverse=True)
            place = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
            hot = known[place] == distinct if len(known) else np.zeros(len(distinct), dtype=bool)
            sums = [np.zeros(len(sizes))] * 2
            if len(known):
                sums = [np.bincount(of, weights=np.where(hot, x[place], 0)[at], minlength=len(sizes)) for x in (target, background)]
            columns = [part.column("doc_id"), pa.array(sizes.astype(np.int64)), *(pa.array(x.astype(float)) for x in sums)]
            names = ["doc_id", "n_tokens", "target", "background"]
            if whole and not hot.all():
                raise ValueError("a bigram is not among the counted ones")
            if not whole:
                cold = ~hot[at]
                pairs, times = np.unique(of[cold].astype(np.uint64) << np.uint64(32) | keys[cold], return_counts=True)
                ends = np.searchsorted(pairs >> np.uint64(32), np.arange(len(sizes) + 1)).astype(np.int32)
                members = pa.StructArray.from_arrays([pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(times)], names=["key", "times"])
                columns, names = [*columns, part.column("row"), pa.ListArray.from_arrays(ends, members)], [*names, "row", "cold"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(tokens, run, schema + ("" if whole else ", row long, cold array<struct<key: long, times: long>>"))


def score(docs: DataFrame, target_ids: DataFrame, rank_file: str, pattern: str, vocabulary: int, *, id_column: str = "doc_id", text_column: str = "text", hot_entries: int = HOT) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every document; losses are means per token."""
    tokens, table = losses(docs, target_ids, rank_file, pattern, vocabulary, id_column=id_column, text_column=text_column)
    table = stored(table, "lm-losses")
    cut = _cut(table, hot_entries)
    if cut == 1:
        total = _looked_up(tokens, table, vocabulary, whole=True)
    else:
        numbered = tokens.withColumn("row", F.monotonically_increasing_id())
        total = stored(_looked_up(numbered, table.filter(F.col("n") >= cut), vocabulary, whole=False), "lm-looked-up")
        cold = total.select("row", F.explode("cold").alias("c")).select("row", "c.key", "c.times")
        # the same plan at every size: a rare bigram has fewer than ``cut`` rows, so none is hot
        joined = cold.join(table.filter(F.col("n") < cut).select("key", F.col("target").alias("t"), F.col("background").alias("b")).hint("merge"), "key")
        sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("t")).alias("t"), F.sum(F.col("times") * F.col("b")).alias("b"))
        added = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0.0))).alias(c)
        total = total.drop("cold").join(sums.hint("merge"), "row", "left").select("doc_id", "n_tokens", added("target", F.col("t")), added("background", F.col("b")))
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    return total.select(
        "doc_id", "n_tokens", (F.col("target") / n).alias("target_loss"), (F.col("background") / n).alias("background_loss"),
        ((F.col("background") - F.col("target")) / n).alias("score"),
    )
