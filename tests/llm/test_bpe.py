import base64
import hashlib
import struct

import public_tokenizers as P
import tiktoken
from samples import ODD

from vicinal.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


def round_trip(docs):
    return bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)


def test_odd_rows_come_back(odd, none):
    got = sorted(((r.doc_id or 0, bytes(r.decoded)) for r in round_trip(odd).collect()))
    assert got == sorted((i or 0, (t or "").encode()) for i, t in ODD)
    assert round_trip(none).count() == 0
    at_once = sorted(((r.doc_id or 0, bytes(r.decoded)) for r in bpe.round_trip(odd, RANKS, P.PATTERN).collect()))
    assert at_once == got and bpe.round_trip(none, RANKS, P.PATTERN).count() == 0


def test_pieces_have_the_ids_of_the_whole(monkeypatch):
    coder = bpe.codec(RANKS, P.PATTERN)
    for text in ("Don't  stop, l'été   à 3.14 km!\n\n ok  " * 60, "a" * 900, " " * 500 + "b c d" * 50, "日本語 テキスト。 " * 90):
        whole = coder.encode(text).tolist()
        monkeypatch.setattr(bpe, "PIECE_CHARS", 40)
        assert "".join(bpe.pieces(text, 40)) == text
        assert coder.encode(text).tolist() == whole
        monkeypatch.undo()


def test_raw_bytes_decode():
    coder = bpe.codec(RANKS, P.PATTERN)
    ids = coder.encode("☃")
    assert coder.decode(ids[:1]) == "☃".encode()[: len(coder.decode(ids[:1]))]


def test_digests_by_plain_hashes(odd):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.round_trip(odd, RANKS, P.PATTERN)).collect())
    coder = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    want = []
    for i, text in ODD:
        ids = coder.encode_ordinary(text or "")
        want.append((i or 0, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
