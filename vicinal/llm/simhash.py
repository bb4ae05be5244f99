"""SimHash near-duplicates by an inverted index on the bytes of the fingerprint.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of their 8 bytes.
The index lists fingerprints under positional bytes, three at a time: the 20 triples below
meet every 4 positions, so a pair with 4 equal bytes shares a list. Within a list the equal
positional bytes of pairs are tallied, pairs with at least 4 are kept, and the bits are
compared. Equal fingerprints are one entry. A list gives a spanning forest of its links, not
all its pairs; long lists are dealt out in blocks, and every two blocks meet in one task.

Why triples: lists of single positional bytes hold a 256th of n fingerprints each, so their pairs
are n * n / 64 in number, 690 million of the 210,000 fingerprints of half a gigabyte of documents.
Lists of triples hold a 2**24th; 20 of them have n * n / 1.7 million pairs by chance, 26,000 of these.
Hot components and fingerprints of very many documents are dealt over several tasks where they are
joined to their class.

Null and empty texts have fingerprint zero and link like any other; repeated rows are rows of
their own; an empty table gives an empty one; other columns are ignored. A null id stays null
and does not name a component while another id does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import shingles
from vicinal.llm.common import map_arrow, rows_of, slices, spread_join
from vicinal.llm.components import components
from vicinal.sources import stored

SHINGLE_WORDS, SEED, MOST_BITS = 4, 42, 4
#: Fingerprints of one list that a task compares; longer lists are dealt out in blocks of half that.
LIST_ROWS = 8192


def _triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions of which every 4 positions hold one (three cyclic classes)."""
    kind = lambda p: p % 3
    found = []
    for t in combinations(range(8), 3):
        kinds = sorted(map(kind, t))
        twice = next((k for k in range(3) if kinds.count(k) == 2), None)
        if len(set(kinds)) == 1 or twice is not None and kinds.count((twice + 1) % 3) == 1:
            found.append(t)
    assert all(any(set(t) <= set(four) for t in found) for four in combinations(range(8), 4))
    return found


TRIPLES = _triples()


def fingerprint(text: str) -> int:
    """The SimHash of one text, unsigned."""
    return int(_fingerprints([text])[0])


def _hashes(text: str) -> list[int]:
    words = text.encode("utf-8").lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return []
    if len(words) <= SHINGLE_WORDS:
        return [digest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - SHINGLE_WORDS + 1].tolist()
    return [digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE_WORDS - 1 :] - 1).tolist(), strict=True)]


def _fingerprints(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(_hashes(text), dtype=">u8")
        counts = np.zeros(64, dtype=np.int64)
        for start in range(0, len(hashes), 1 << 16):  # bits of so many shingles at once
            bits = np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int32)
        out[i] = np.packbits(counts * 2 > len(hashes)).view(">u8")[0] if len(hashes) else 0
    return out


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp``; fp holds the 64 bits as a signed long."""
    rows = rows_of(docs, id_column, text_column)

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "text"):
            found = _fingerprints(part.column("text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _sketched(rows: DataFrame) -> DataFrame:
    """``doc_id, fp`` and what ``shingles.links`` needs, in one pass over the texts."""

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "text", 1 << 20):
            texts = part.column("text").to_pylist()
            columns = [part.column("doc_id"), pa.array(_fingerprints(texts).view(np.int64)), *shingles.sketches(texts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "digest", "n", "bands"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, digest long, n long, bands array<long>")


def _forest(fps: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Links that connect what the list's own links connect; each entry is expanded once."""
    out, left = [], np.arange(len(fps))
    raw = fps.view(np.uint8).reshape(-1, 8)
    need = 8 - most_bits
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            tally = (raw[left] == raw[node]).sum(axis=1)
            at = np.flatnonzero(tally >= need)
            if not len(at):
                continue
            at = at[np.bitwise_count(fps[left[at]] ^ fps[node]) <= most_bits]
            out += [(node, x) for x in left[at].tolist()]
            queue += left[at].tolist()
            left = np.delete(left, at)
    return out


def links(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column fp) that connect all that are near."""
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"the index serves up to {MOST_BITS} bits")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(i << 24).cast("long") + byte(a) * 65536 + byte(b) * 256 + byte(c) for i, (a, b, c) in enumerate(TRIPLES)]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    half = LIST_ROWS // 2
    blocks = F.when(F.col("n") <= LIST_ROWS, 1).otherwise(F.ceil(F.col("n") / half)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j"))))
    dealt = index.join(lists, "key").withColumn("blocks", blocks).withColumn("own", own).select("key", "fp", pairs.alias("at"))
    dealt = dealt.select("key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "fp")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def close():
            fps = np.unique(np.concatenate(held))
            found = _forest(fps.view(np.uint64), most_bits)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
            fp = batch.column("fp").to_numpy()
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                here = tuple(c[start] for c in cols)
                if here != at and held:
                    yield from close()
                    held = []
                at = here
                held.append(fp[start:stop])
        if held:
            yield from close()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id that links of at most ``most_bits`` bits reach."""
    prints = stored(fingerprints(docs, id_column=id_column, text_column=text_column), "simhash")
    distinct = _distinct(prints)
    return _classes(prints, distinct, links(distinct, most_bits))


def _distinct(prints: DataFrame) -> DataFrame:
    return stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")


def _classes(prints: DataFrame, distinct: DataFrame, near: DataFrame) -> DataFrame:
    roots = components(near)
    root = F.coalesce(roots["root"], distinct["fp"])
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", root.alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = spread_join(named, least, "root", ["fp"]).select("fp", "component_id")
    return spread_join(prints, classes, "fp", ["doc_id"], "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, most_bits: int = MOST_BITS, least: float = shingles.LEAST, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: one of each component, that of its least id.

    Links are those of the fingerprints and those of texts whose five-word shingles have a
    likeness of ``least`` or more: most of these differ in more bits than the index serves.
    Rows without an id cannot be named by a component; of these, one of each text stays.
    """
    named = docs.filter(docs[id_column].isNotNull())
    rows = rows_of(named, id_column, text_column)
    sketched = stored(_sketched(rows), "simhash-shingles")
    prints = sketched.select("doc_id", "fp")
    distinct = _distinct(prints)
    found = _classes(prints, distinct, links(distinct, most_bits).unionByName(shingles.links(sketched, rows, least)))
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias(id_column))
    kept = named.join(first, id_column, "left_semi").dropDuplicates([id_column])
    nameless = docs.filter(docs[id_column].isNull()).dropDuplicates([text_column])
    return kept.select(*docs.columns).unionByName(nameless)


def hexadecimal(fp) -> F.Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
