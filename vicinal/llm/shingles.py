"""Near copies by five-word shingles: MinHash bands propose, whole sets of shingles decide.

Words are those of the fingerprints: bytes between white space, ASCII letters lower-cased. A
text of fewer words has one shingle, an empty text none. ``BANDS`` keys of ``ROWS`` minima each
miss a pair of likeness 0.8 once in 300,000. Texts that share keys, directly or by others, are
a group; every set goes to its group once, large groups are dealt out in blocks of which every
two meet in one task. There the sets of texts that share a key are compared whole, and a
spanning forest of the links is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import map_arrow, runs, slices, word_hashes
from vicinal.llm.components import components
from vicinal.sources import stored

LEAST, WORDS, BANDS, ROWS = 0.8, 5, 32, 5
#: Shingles of one group that a task compares; larger groups are dealt out in blocks of half that.
GROUP_SHINGLES = 2 << 20

_rng = np.random.default_rng(17)
_MIXES = _rng.integers(1, 1 << 32, (BANDS * ROWS, 2), dtype=np.uint32) | np.array([0, 1], dtype=np.uint32)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sets of shingles, sorted 64-bit hashes, of texts."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    raw = np.frombuffer(b" ".join(w for words in split for w in words), dtype=np.uint8)
    ids = word_hashes(raw, *runs(raw != 32))
    out, base = [], 0
    for words in split:
        own = ids[base : base + len(words)]
        base += len(words)
        key = np.zeros(max(1, len(own) - WORDS + 1) if len(own) else 0, dtype=np.uint64)
        for i in range(min(WORDS, len(own))):
            key = key * _MULTIPLIER + own[i : i + len(key)]
        key = (key ^ key >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(np.unique(key ^ key >> np.uint64(31)))
    return out


def digest(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(set, band) the keys of sets that are not empty."""
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((BANDS, len(sets)), dtype=np.uint64)
    for i, (xor, factor) in enumerate(_MIXES):
        band = i // ROWS
        keys[band] = (keys[band] + np.uint64(band + 1)) * _MULTIPLIER + np.minimum.reduceat((low ^ xor) * factor, starts)
    keys = (keys ^ keys >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ keys >> np.uint64(31)).view(np.int64).T


def sketches(texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Digest, number of shingles and band keys of texts; an empty text has no keys."""
    sets = shingle_sets(texts)
    some = [i for i, x in enumerate(sets) if len(x)]
    keys: list = [[]] * len(sets)
    if some:
        for i, row in zip(some, bands([sets[i] for i in some]), strict=True):
            keys[i] = row
    return pa.array(map(digest, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.list_(pa.int64()))


def _forest(sets: list[np.ndarray], keys: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that connect what the group's own links connect; each entry is expanded once."""
    out, left = [], np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            n = sizes[left]
            at = np.flatnonzero((np.minimum(n, sizes[node]) >= least * np.maximum(n, sizes[node])) & (keys[left] == keys[node]).any(axis=1))
            if not len(at):
                continue
            near = left[at]
            whole = np.concatenate([sets[x] for x in near])
            place = np.minimum(np.searchsorted(sets[node], whole), sizes[node] - 1)
            shared = np.add.reduceat((sets[node][place] == whole).astype(np.int64), np.cumsum([0, *sizes[near][:-1]]))
            at = at[shared >= least * (sizes[near] + sizes[node] - shared) - 1e-9]
            out += [(node, x) for x in left[at].tolist()]
            queue += left[at].tolist()
            left = np.delete(left, at)
    return out


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), (offsets - offsets[0])[1:-1])


def links(sketched: DataFrame, rows: DataFrame, least: float = LEAST) -> DataFrame:
    """``a, b``: links between fingerprints of texts whose shingles have a likeness of ``least`` or more, that connect all such.

    ``sketched`` has ``doc_id, fp, digest, n, bands`` of the texts in ``rows`` (``doc_id, text``; no id is null).
    """
    entries = sketched.filter("n > 0").groupBy("digest").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    entries = stored(entries, "shingles")
    same = sketched.filter("n > 0").select("digest", F.col("fp").alias("b")).distinct().join(entries.select("digest", F.col("fp").alias("a")), "digest").filter("a <> b")
    index = entries.select("digest", F.explode("bands").alias("key"))
    heads = index.groupBy("key").agg(F.min("digest").alias("head"), F.count("*").alias("times")).filter("times > 1")
    stars = index.join(heads, "key").filter("digest <> head").select(F.col("head").alias("a"), F.col("digest").alias("b"))
    groups = components(stars).select(F.col("node").alias("digest"), "root")
    members = stored(entries.join(groups, "digest"), "shingle-groups")

    half = GROUP_SHINGLES // 2
    sizes = members.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("times")).filter("times > 1")
    blocks = F.when(F.col("total") <= GROUP_SHINGLES, 1).otherwise(F.ceil(F.col("total") / half)).cast("int")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j"))))

    def sets(batch: pa.RecordBatch):
        for part in slices(batch, "text", 1 << 20):
            found = shingle_sets(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, found), pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["digest", "shingles"])

    texts = rows.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    whole = map_arrow(texts, sets, "digest long, shingles array<long>").dropDuplicates(["digest"])
    dealt = members.join(sizes, "root").withColumn("blocks", blocks).withColumn("own", own).join(whole, "digest")
    dealt = dealt.select("root", "digest", "fp", "bands", "shingles", pairs.alias("at")).select("root", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "digest", "fp", "bands", "shingles")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps: list[int] = []
        found: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        at = None

        def close():
            near = _forest(found, np.stack(keys), least)
            if near:
                a, b = np.array(near).T
                names = np.array(fps, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            where = zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j")), strict=True)
            for here, fp, own_keys, own_set in zip(where, batch.column("fp").to_pylist(), _lists(batch.column("bands")), _lists(batch.column("shingles")), strict=True):
                if here != at and fps:
                    yield from close()
                    fps, found, keys = [], [], []
                at = here
                fps.append(fp)
                keys.append(own_keys.copy())
                found.append(own_set.view(np.uint64).copy())
        if fps:
            yield from close()

    return dealt.mapInArrow(run, "a long, b long").unionByName(same.select("a", "b")).filter("a <> b").distinct()
