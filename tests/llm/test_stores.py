"""The token store and the archives: exact round trips."""

import base64
import glob
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from samples import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vicinal.llm import cas, common, warc

WORDS = P.path("word_bpe_49k.json")


def ids_of(text):
    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 2]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_store_round_trip(spark, make, tmp_path):
    rows = [*ODD, (8, "It's ΣΑΣ x²½ İ a\x01b <|endoftext|> don't\x0b\x1c z ﬁ"), (9, "mixed Case, words. " * 3000), (10, "mixed Case, words. " * 2999)]
    path = f"file://{tmp_path}/store"
    cas.write(make(rows), path, WORDS, 2)
    start, want = 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        ids = ids_of(t)
        want.append((start, i, len(ids), packed(ids)))
        start += len(ids)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in cas.read(spark, path).collect())
    assert got == [(s, i, n, zlib.crc32(b)) for s, i, n, b in want]
    back = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in cas.reconstruct(spark, path).collect())
    assert back == want
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    stored = chunks.agg(F.sum(F.length("ids"))).first()[0]
    assert stored < 2 * sum(n for _, _, n, _ in want) * 0.7  # the long copies share most chunks


def thue_morse(n, a, b):
    """Words that collide under every polynomial hash modulo a power of two."""
    while len(a) < n:
        a, b = a + b, b + a
    return a


def test_words_that_collide_under_polynomial_hashes(spark, make, tmp_path):
    rows = [(10 * n + i, thue_morse(n, *x)) for n in (1024, 2048, 4096) for i, x in enumerate(("ab", "ba"))]
    cas.write(make(rows), f"file://{tmp_path}/s", WORDS, 2)
    want = {i: zlib.crc32(packed(ids_of(t))) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in cas.read(spark, f"file://{tmp_path}/s").collect()} == want


def test_ids_are_those_of_the_library():
    rng = random.Random(3)
    texts = ["see <|endoftext|> here<|startoftext|>x", "ȺB Ⱦ İx", " ".join(map(chr, cas._HERE)), "“a” — l’été\u2028x", "a\xa0b\x85c\ud7ff"]
    texts += ["".join(rng.choice([chr(rng.randrange(0x260)), chr(rng.randrange(32, 127)), "'", " ", chr(rng.randrange(0x2000, 0x2030))]) for _ in range(300)) for _ in range(200)]
    texts += ["".join(chr(rng.choice(cas._HERE)) if rng.random() < 0.4 else rng.choice("abcdefgh 'st1.") for _ in range(300)) for _ in range(200)]
    tokenizer, coder = Tokenizer.from_file(WORDS), cas.Encoder(WORDS)
    ids, ends = coder.encode(texts, 2)
    for text, got in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert got.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_a_tokenizer_of_other_rules(tmp_path):
    other = P.path("byte_bpe_50k.json")
    coder, tokenizer = cas.Encoder(other), Tokenizer.from_file(other)
    assert not coder._by_words
    for text in ("Two  words\n", "ÄÖ x", ""):
        assert coder.encode([text], 2)[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_full_tables_are_emptied_one_by_one(monkeypatch):
    """Pieces outlive the words that they were met in, and ids are the same whichever table is emptied."""
    monkeypatch.setattr(cas, "CACHE_WORDS", 40)
    tokenizer, draw = Tokenizer.from_file(WORDS), random.Random(23)
    texts = ["".join(draw.choice("abcé'1., \n") for _ in range(120)) for _ in range(30)]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for most in (1_000_000, 10):
        monkeypatch.setattr(cas, "CACHE_PIECES", most, raising=False)
        coder = cas.Encoder(WORDS)
        for i in range(0, 30, 2):
            ids, ends = coder.encode(texts[i : i + 2], 2)
            assert [x.tolist() for x in np.split(ids, ends[:-1])] == want[i : i + 2]
        assert len(coder._words) < 100 and (len(coder._pieces) > 100) == (most > 10)


def test_roots_of_streamed_leaves():
    for n in range(40):
        leaves, tree = [cas.digest(bytes([i])) for i in range(n)], cas.Merkle()
        for leaf in leaves:
            tree.add(leaf)
        assert tree.root() == cas.merkle(leaves)


def test_hot_chunks_are_dealt(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, "") for i in range(40)] + [(100 + i, "one text") for i in range(30)] + [(200, "another")]
    cas.write(make(rows), f"file://{tmp_path}/s", WORDS, 2)
    want = {i: zlib.crc32(packed(ids_of(t))) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in cas.read(spark, f"file://{tmp_path}/s").collect()} == want


def test_empty_store(spark, none, tmp_path):
    cas.write(none, f"file://{tmp_path}/s", WORDS, 2)
    assert cas.read(spark, f"file://{tmp_path}/s").count() == 0


def test_damage_is_noticed(spark, make, tmp_path):
    path = f"{tmp_path}/s"
    cas.write(make([(1, "some words here")]), f"file://{path}", WORDS, 2)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    bad = [(r.hash, bytearray(r.ids[:-1] + bytes([r.ids[-1] ^ 1]))) for r in chunks]
    spark.createDataFrame(bad, "hash binary, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="does not fit its address"):
        cas.read(spark, f"file://{path}").collect()


def test_checksums_join():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 4096):
        a, b = rng.bytes(33), rng.bytes(n)
        assert cas.crc_join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_chunks_do_not_depend_on_place():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 5000, 20000).astype("<u2")
    whole = set(np.split(ids, cas.cuts(ids))[k].tobytes() for k in range(5, 20))
    moved = np.concatenate([rng.integers(0, 5000, 333).astype("<u2"), ids])
    assert len(whole & {c.tobytes() for c in np.split(moved, cas.cuts(moved))}) >= 13


PAGES = [(3, "u3", "<p>same</p>"), (1, "u1", "<p>same</p>"), (2, None, None), (5, "u\n5", ""), (4, "u4", "ü☃" * 40000), (6, "u6", "a\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "<p>same</p>"), (1, "u1", "<p>same</p>")]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in PAGES], "page_id long, url string, html string, payload string, first int")
    warc.write_pages(pages, f"file://{tmp_path}/w", compression=compression)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {"<p>same</p>": 1, "": 2}
    want = []
    for i, _, h in PAGES:
        of = first.get(h or "", i)
        want.append((str(i), len((h or "").encode()), digest(h), "response" if of == i else "revisit", None if of == i else str(of)))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(spark, f"file://{tmp_path}/w").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    few = spark.read.format("warc").load(f"file://{tmp_path}/w").filter("record_type = 'response' and content_length > 1000")
    assert [r.page_id for r in few.collect()] == ["4"] and "PythonDataSource" in few._jdf.queryExecution().toString() or few.count() == 1


def test_foreign_archives_and_skipping(spark, tmp_path):
    raw = [warc.record({"record_type": t, "record_id": f"<r{i}>"}, bytes([65 + i]) * (10 + 70000 * (i % 2))) for i, t in enumerate(("warcinfo", "request", "response", "metadata"))]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw))
    (tmp_path / "two.warc").write_bytes(b"".join(raw))
    (tmp_path / "all.warc.gz").write_bytes(gzip.compress(b"".join(raw)))
    (tmp_path / "own.warc.gz").write_bytes(b"".join(map(warc.member, raw)))
    warc.register(spark)
    for f in glob.glob(f"{tmp_path}/*.warc*"):
        rows = spark.read.format("warc").load(f"file://{f}").collect()
        assert [(r.record_id, r.payload[:1], r.content_length) for r in rows] == [(f"<r{i}>", bytes([65 + i]), 10 + 70000 * (i % 2)) for i in range(4)]
        assert [r.record_id for r in spark.read.format("warc").option("payload", "false").load(f"file://{f}").filter("record_type in ('response', 'metadata')").collect()] == ["<r2>", "<r3>"]


def test_a_skipped_payload_is_not_read(tmp_path):
    raw = [warc.record({"record_type": t}, np.random.default_rng(1).bytes(900_000)) for t in ("request", "response", "request")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.member, raw)))
    read = 0

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            nonlocal read
            read += n
            return self.f.read(n)

        def seek(self, n):
            self.f.seek(n)

        def tell(self):
            return self.f.tell()

    with open(tmp_path / "a.warc.gz", "rb") as f:
        rows = list(warc._records(warc._Gzip(Counted(f)), lambda row: False, True))
    assert rows == [] and read < 400_000


def test_archive_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(pages, f"file://{tmp_path}/w")
    assert warc.read_pages(spark, f"file://{tmp_path}/w").count() == 0


def test_uncommitted_files_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    warc.write_pages(pages, f"file://{tmp_path}/w")
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(warc.member(warc.record({"record_type": "response"}, b"x")))
    assert warc.read_pages(spark, f"file://{tmp_path}/w").count() == 1
