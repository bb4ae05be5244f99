"""Token ids in a content-addressed store.

Documents are encoded with the tokenizers library, the end id is appended, and the id stream
of a document is cut into chunks where a rolling hash of its last 16 ids says so. A store is

* ``chunks``: hash, ids (packed little-endian) - every distinct chunk once,
* ``recipes``: shard, pos, doc_id, n_tokens, hashes, sizes, root - in ascending id order,
* ``manifest``: shard, docs, tokens, root - Merkle roots over the documents of a shard,
* ``root``: the Merkle root over the shards, bytes per id, and the end id.

All are Parquet, written by Spark, so any shared file system serves, a failed writer leaves
no half files, and lost tasks are repeated. Null and empty texts are the end id alone;
repeated rows are documents of their own; null ids come first; an empty table gives an empty
store; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from vicinal.llm.common import distinct_words, map_arrow, rows_of, runs, slices, spread_join
from vicinal.sources import stored

WINDOW, LEAST, MOST, MASK = 16, 64, 4096, np.uint32((1 << 9) - 1)
#: Words, and pieces of words, that a process keeps the ids of; each table is emptied when full.
CACHE_WORDS, CACHE_PIECES = 1_000_000, 1_000_000
#: New pieces that the model gets at once.
LINE_PIECES = 256

# One random 32-bit number per id, from a fixed multiplicative generator.
_MIX = np.uint32(2654435761)


def merkle(digests: list[bytes]) -> bytes:
    """Root over digests in order; an odd one out moves up unchanged; nothing gives 16 zero bytes."""
    if not digests:
        return bytes(16)
    while len(digests) > 1:
        paired = [hashlib.blake2b(b"\x01" + digests[i] + digests[i + 1], digest_size=16).digest() for i in range(0, len(digests) - 1, 2)]
        digests = paired + digests[len(digests) - len(digests) % 2 :]
    return digests[0]


def digest(packed: bytes) -> bytes:
    """Address of a chunk."""
    return hashlib.blake2b(b"\x00" + packed, digest_size=16).digest()


def _marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: where a hash of the last 16 ids has nine zero bits."""
    mixed = (ids.astype(np.uint32) + np.uint32(1)) * _MIX
    mixed ^= mixed >> np.uint32(15)
    rolled = np.zeros(len(ids), dtype=np.uint32)
    for k in range(min(WINDOW, len(ids))):
        rolled[k:] += mixed[: len(ids) - k] * np.uint32(2 * k + 1)
    rolled ^= rolled >> np.uint32(13)
    return np.flatnonzero(((rolled * _MIX) >> np.uint32(11) & MASK) == 0) + 1


def _ends(marks: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the ids from start to stop; chunks have ``LEAST`` to ``MOST`` ids, the last may have fewer."""
    out = []
    for at in marks:
        while at - start > MOST:
            start += MOST
            out.append(start)
        if at - start >= LEAST:  # the 16 ids that the mark depends on are in this chunk
            start = at
            out.append(at)
    while stop - start > MOST:
        start += MOST
        out.append(start)
    return out if start == stop else [*out, stop]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document; they depend on the ids near them, not on their place."""
    return _ends(_marks(ids).tolist(), 0, len(ids))


# The rules by which the word-level vocabulary file cuts texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


# Texts of these characters are cut here as a tokenizer with the rules above cuts them, provided
# that they are in composed form: white space parts words, words are lower-cased and fall into
# letters, single numbers, contractions and the rest. All others go through the tokenizer whole.
def _cut_here(code: int) -> bool:
    """White space and printable characters of the Latin blocks and of common punctuation, that stay there in lower case."""
    lower = chr(code).lower()
    return code in (9, 10, 13) or (32 <= code < 127 or 160 < code < 0x250 or 0x2010 <= code < 0x2028) and len(lower) == 1 and (ord(lower) < 0x250 or code >= 0x2010)


_HERE = [c for c in range(0x2028) if _cut_here(c)]
_OTHER = re.compile(f"[^{re.escape(''.join(map(chr, _HERE)))}]")


def _class(category: str) -> str:
    return "".join(re.escape(chr(c)) for c in _HERE if unicodedata.category(chr(c))[0] == category)


_CUT = re.compile(_PATTERN.replace(r"[\p{N}]|", r"[\p{N}]|\n|").replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N")))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from 256 on."""
    out, spare = [], 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte:
            out.append(chr(byte))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Numbers(dict):
    """Numbers of things, in the order in which they are first met."""

    def of(self, keys: list) -> tuple[np.ndarray, list]:
        """The number of each, and those that are new."""
        out = np.fromiter(map(self.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        at = np.flatnonzero(out < 0)
        missing = [keys[i] for i in at.tolist()]
        fresh = list(dict.fromkeys(missing))
        self.update(zip(fresh, range(len(self), len(self) + len(fresh)), strict=True))
        out[at] = np.fromiter(map(self.__getitem__, missing), dtype=np.int64, count=len(missing))
        return out, fresh


class Pool:
    """Sequences of ids by number."""

    def __init__(self, kind: np.dtype):
        self._ids, self._starts, self._sizes = np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(sizes) - sizes])
        self._ids, self._sizes = np.concatenate([self._ids, ids.astype(self._ids.dtype)]), np.concatenate([self._sizes, sizes])

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences after each other, and where each ends."""
        sizes = self._sizes[numbers]
        upto = np.cumsum(sizes)
        source = np.repeat(self._starts[numbers] - (upto - sizes), sizes)
        source += np.arange(len(source))
        return self._ids[source], upto


class Encoder:
    """Ids of whole texts, those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    A tokenizer with the rules above drops white space and merges within the pieces of a word, so
    the ids of a text are those of its pieces in order, and each distinct word and piece goes to
    the library's model once. Words are keyed by themselves, not by hashes. Tokenizers with other
    rules, and texts that hold an added token or unusual characters, are encoded by the library.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        rules = json.loads(self._tokenizer.to_str())
        self._by_words = all(rules[name] == rule for name, rule in (("normalizer", _NORMALIZER), ("pre_tokenizer", _PRE_TOKENIZER), ("truncation", None), ("padding", None)))
        self._added = [t["content"] for t in rules["added_tokens"]]
        self.wide = self._tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        letters = _byte_letters()
        self._feed = letters[10]
        letters[32] = " "  # parts the pieces, none holds one
        self._letters = np.array([ord(x) for x in letters], dtype="<u2")
        model = Tokenizer.from_file(tokenizer_file).model  # for pieces that are cut and spelled in byte letters; each comes once, so its cache is idle
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)
        self._bare = Tokenizer(model)
        self._bare.pre_tokenizer = WhitespaceSplit()
        self._feed_ids = self._bare.encode(self._feed, add_special_tokens=False).ids
        self._by_words &= len(self._feed_ids) == 1
        self._forget_words()
        self._forget_pieces()

    def _forget_words(self) -> None:
        self._words, self._word_ids = Numbers(), Pool(self.kind)

    def _forget_pieces(self) -> None:
        """A line feed is a piece without ids. The words' ids do not depend on the table, so it may go before or after theirs."""
        self._pieces, self._piece_ids = Numbers({"\n": 0}), Pool(self.kind)
        self._piece_ids.add(np.zeros(0, dtype=self.kind), np.zeros(1, dtype=np.int64))

    def _learn(self, words: list[bytes]) -> None:
        """Add new words to the table. The library's model gets some new pieces at a time as one line, a line feed after each."""
        if len(self._pieces) > CACHE_PIECES:
            self._forget_pieces()
        at, fresh = self._pieces.of(_CUT.findall(b"\n".join(words).decode().lower() + "\n"))
        lines = []
        for start in range(0, len(fresh), LINE_PIECES):
            line = " \n ".join(fresh[start : start + LINE_PIECES]) + " \n"
            lines.append(self._letters[np.frombuffer(line.encode(), dtype=np.uint8)].tobytes().decode("utf-16-le"))
        parts = [e.ids for e in self._bare.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(parts), dtype=np.int64, count=sum(map(len, parts)))
        feeds = np.flatnonzero(ids == self._feed_ids[0])
        self._piece_ids.add(np.delete(ids, feeds), np.diff(feeds, prepend=-1) - 1)
        ids, upto = self._piece_ids.get(at)
        self._word_ids.add(ids, np.diff(upto[at == 0], prepend=0))

    def _latin(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [t.encode() for t in texts]
        raw = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
        starts, ends = runs(raw > 32)  # the smaller bytes are white space in these texts
        words, of = distinct_words(raw, starts, ends)
        if len(self._words) + len(words) > CACHE_WORDS:
            self._forget_words()
        numbers, fresh = self._words.of(words.tolist())
        if fresh:
            self._learn(fresh)
        ids, upto = self._word_ids.get(numbers[of])
        words_before = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
        last = np.concatenate([[0], upto])[words_before]
        return np.insert(ids, last, self.kind.type(end_id)), last + np.arange(1, len(last) + 1)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, each with the end id, and where each ends."""
        plain = [self._by_words and _OTHER.search(t) is None and unicodedata.is_normalized("NFC", t) and not any(a in t for a in self._added) for t in texts]
        if all(plain):
            return self._latin(texts, end_id)
        ids, ends = self._latin([t for t, p in zip(texts, plain, strict=True) if p], end_id) if any(plain) else (np.zeros(0, self.kind), np.zeros(0, np.int64))
        easy = iter(np.split(ids, ends[:-1]))
        parts = [
            next(easy) if p else np.array([*self._tokenizer.encode(t, add_special_tokens=False).ids, end_id], dtype=self.kind)
            for t, p in zip(texts, plain, strict=True)
        ]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])


@cache
def encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def _cut(docs: DataFrame, tokenizer_file: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """Rows of two kinds: a recipe per document, and each chunk that is new to its part of a task."""
    rows = rows_of(docs, id_column, text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = [("doc_id", pa.array([], "int64").type), ("n_tokens", pa.int64()), ("hashes", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("root", pa.binary()), ("hash", pa.binary()), ("ids", pa.binary())]

    def run(batch: pa.RecordBatch):
        gc.disable()  # the many small lists of a batch hold no cycles, and looking for some takes a sixth of the time
        coder = encoder(tokenizer_file)
        types = [batch.column("doc_id").type, *(t for _, t in columns[1:])]
        names = [n for n, _ in columns]
        for part in slices(batch, "text"):
            recipes, chunks, start = [], {}, 0
            ids, stops = coder.encode(part.column("text").to_pylist(), end_id)
            marks = _marks(ids)
            own = np.searchsorted(marks, np.concatenate([[0], stops]), "right").tolist()
            marks, raw, width = marks.tolist(), ids.tobytes(), ids.itemsize
            for i, stop in enumerate(stops.tolist()):
                hashes, sizes, n = [], [], stop - start
                for end in _ends(marks[own[i] : own[i + 1]], start, stop):
                    packed = raw[start * width : end * width]
                    hashes.append(digest(packed))
                    sizes.append(end - start)
                    chunks[hashes[-1]] = packed
                    start = end
                recipes.append((n, hashes, sizes, merkle(hashes)))
            made = [part.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*recipes, strict=True), types[1:5], strict=True))]
            yield pa.RecordBatch.from_arrays([*made, pa.nulls(len(recipes), pa.binary()), pa.nulls(len(recipes), pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(chunks), t) for t in types[:5]), pa.array(chunks.keys(), pa.binary()), pa.array(chunks.values(), pa.binary())], names=names
            )

    schema = f"doc_id {kind}, n_tokens long, hashes array<binary>, sizes array<int>, root binary, hash binary, ids binary"
    return map_arrow(rows, run, schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, pos = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(pos, pos + n)), *batch.columns], names=["shard", "pos", *batch.schema.names]
        )
        pos += n


class Merkle:
    """The root of ``merkle`` over digests that come one by one; only the roots of full subtrees are held."""

    def __init__(self):
        self._full: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self._full and self._full[-1][0] == level:
            leaf, level = merkle([self._full.pop()[1], leaf]), level + 1
        self._full.append((level, leaf))

    def root(self) -> bytes:
        out = self._full[-1][1] if self._full else bytes(16)
        for _, left in self._full[-2::-1]:
            out = merkle([left, out])
        return out


def _shard_roots(recipes: DataFrame) -> DataFrame:
    """``shard, docs, tokens, root``; the rows of a shard pass through a task in order, and none are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs, tokens, tree = None, 0, 0, Merkle()

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([docs]), pa.array([tokens]), pa.array([tree.root()], pa.binary())], names=["shard", "docs", "tokens", "root"]
            )

        for batch in batches:
            for own, n, root in zip(*(batch.column(c).to_pylist() for c in ("shard", "n_tokens", "root")), strict=True):
                if own != shard:
                    if docs:
                        yield done()
                    shard, docs, tokens, tree = own, 0, 0, Merkle()
                docs, tokens = docs + 1, tokens + n
                tree.add(root)
        if docs:
            yield done()

    ordered = recipes.select("shard", "pos", "n_tokens", "root").repartition("shard").sortWithinPartitions("shard", "pos")
    return ordered.mapInArrow(run, "shard int, docs long, tokens long, root binary")


def _top(shards: DataFrame) -> bytes:
    """Root over the shards: one row per file of recipes comes to the driver, 16 bytes each."""
    return merkle([bytes(row.root) for row in shards.select("shard", "root").orderBy("shard").toLocalIterator()])


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, *, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode all documents and write them as a store."""
    spark = docs.sparkSession
    cut = stored(_cut(docs, tokenizer_file, end_id, id_column, text_column), "cut")
    chunks = cut.filter("hash is not null").groupBy("hash").agg(F.first("ids").alias("ids"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = cut.filter("root is not null").select("doc_id", "n_tokens", "hashes", "sizes", "root")
    ordered = recipes.repartitionByRange("doc_id", F.xxhash64("root")).sortWithinPartitions("doc_id", F.xxhash64("root"))
    kind = recipes.schema["doc_id"].dataType.simpleString()
    numbered = ordered.mapInArrow(_numbered, f"shard int, pos long, doc_id {kind}, n_tokens long, hashes array<binary>, sizes array<int>, root binary")
    numbered.write.parquet(f"{path}/recipes")
    _shard_roots(spark.read.schema(numbered.schema).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    top = _top(spark.read.parquet(f"{path}/manifest"))
    width = 4 if encoder(tokenizer_file).wide else 2
    spark.createDataFrame([(bytearray(top), width, end_id)], "root binary, width int, end_id long").coalesce(1).write.parquet(f"{path}/root")


_POLY = 0xEDB88320  # Fixed value: the CRC-32 polynomial, reflected.


def _times(a, b):
    """Product of two reflected polynomials modulo the CRC polynomial, of numbers or arrays."""
    a, b = np.asarray(a, dtype=np.uint32), np.asarray(b, dtype=np.uint32)
    out, one = np.zeros(np.broadcast(a, b).shape, dtype=np.uint32), np.uint32(1)
    for k in range(31, -1, -1):
        out ^= b * (a >> np.uint32(k) & one)
        b = b >> one ^ np.uint32(_POLY) * (b & one)
    return out


@lru_cache(1 << 16)
def _shift(n_bytes: int) -> int:
    """The factor that moves a checksum over so many bytes."""
    power, square, n = np.uint32(1 << 31), np.uint32(1 << 30), 8 * n_bytes
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return int(power)


def crc_join(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two byte strings after each other, from theirs and the length of the second."""
    return int(_times(_shift(n_bytes), first)) ^ second


def _checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Recipes, manifest, chunks and bytes per id; the manifest has been verified against the recipes."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    head = spark.read.parquet(f"{path}/root").first()
    if _top(manifest) != bytes(head.root) or _top(_shard_roots(recipes)) != bytes(head.root):
        raise ValueError(f"the manifest of {path} does not fit its root")
    return recipes, manifest, spark.read.parquet(f"{path}/chunks"), head.width


def _placed(recipes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recipes with the number of ids before each document."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shard_start"))
    own = Window.partitionBy("shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = recipes.select("shard", "pos", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("own_start"))
    placed = starts.join(shards, "shard").select("shard", "pos", (F.col("shard_start") + F.col("own_start")).alias("start"))
    return recipes.join(placed, ["shard", "pos"])


def _verified_root(recipes: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        for hashes, root in zip(batch.column("hashes").to_pylist(), batch.column("root").to_pylist(), strict=True):
            if merkle(hashes) != root:
                raise ValueError("a recipe does not fit its root")
        yield batch

    return map_arrow(recipes, run, recipes.schema.simpleString().removeprefix("struct<").removesuffix(">"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document.

    Every stored chunk is read and held against its address, every recipe against its root and
    the roots against the manifest. The checksum of a document is put together from those of
    its chunks, so chunks are not copied to all documents that hold them.
    """
    recipes, manifest, chunks, width = _checked(spark, path)

    def sums(batch: pa.RecordBatch):
        kind = "<u4" if width == 4 else "<u2"
        hashes, packed = batch.column("hash").to_pylist(), batch.column("ids").to_pylist()
        if any(digest(p) != h for h, p in zip(hashes, packed, strict=True)):
            raise ValueError("a chunk does not fit its address")
        crcs = [zlib.crc32(np.frombuffer(p, kind).astype("<u4").tobytes()) for p in packed]
        yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(crcs, pa.int64()), pa.array([len(p) // width for p in packed], pa.int32())], names=["hash", "crc", "n"])

    known = map_arrow(chunks, sums, "hash binary, crc long, n int")
    parts = _placed(_verified_root(recipes), manifest).select("doc_id", "start", "n_tokens", F.posexplode("hashes").alias("seq", "hash"))
    found = spread_join(parts, known, "hash", ["start", "seq"], "left").groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "crc", "n"))).alias("parts"), F.count("*").alias("k"))
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def join(batch: pa.RecordBatch):
        parts = batch.column("parts")
        starts = parts.offsets.to_numpy().astype(np.int64)
        _, crc_of, n_of = parts.values.flatten()
        if n_of.null_count:
            raise ValueError("chunks of a document are missing")
        sizes, crc_of, n_of = np.diff(starts), crc_of.to_numpy().astype(np.uint32), n_of.to_numpy().astype(np.int64)
        if (np.add.reduceat(n_of, starts[:-1]) != batch.column("n_tokens").to_numpy()).any():
            raise ValueError("chunks of a document are missing")
        crcs = crc_of[starts[:-1]]
        for k in range(1, int(sizes.max())):
            more = np.flatnonzero(sizes > k)
            at = starts[more] + k
            known, place = np.unique(n_of[at], return_inverse=True)
            shift = np.array([_shift(4 * int(n)) for n in known], dtype=np.uint32)[place]
            crcs[more] = _times(shift, crcs[more]) ^ crc_of[at]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(found, join, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: every document's ids, packed as four little-endian bytes each."""
    recipes, manifest, chunks, width = _checked(spark, path)
    parts = _placed(_verified_root(recipes), manifest).select("doc_id", "start", "n_tokens", F.posexplode("hashes").alias("seq", "hash"))
    found = spread_join(parts, chunks, "hash", ["start", "seq"], "left").groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("parts"))
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def join(batch: pa.RecordBatch):
        source = "<u4" if width == 4 else "<u2"
        held = batch.column("parts").to_pylist()
        if any(p["ids"] is None for parts in held for p in parts):
            raise ValueError("chunks of a document are missing")
        ids = [np.frombuffer(b"".join(p["ids"] for p in parts), source).astype("<u4").tobytes() for parts in held]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return map_arrow(found, join, f"doc_id {kind}, start long, n_tokens long, ids binary")
