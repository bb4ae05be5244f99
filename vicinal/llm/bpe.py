"""Byte-level BPE with the tiktoken library and a local rank file.

``encode`` gives packed ids, ``decode`` gives the bytes back. A null text is empty and has no
ids; repeated rows give repeated results; an empty table gives an empty one; columns other
than the named ones are ignored. Long texts are encoded in pieces that are cut where no match
of the pattern can reach across, so the ids are those of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import map_arrow, rows_of, slices

#: Texts above so many characters are cut.
PIECE_CHARS = 50_000

# A single space between letters, digits or punctuation: white-space runs never hold it, and
# every match that takes in the character before it ends there.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}]) (?=[\p{L}\p{N}\p{P}])")


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of at least ``most`` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, without special tokens, as little-endian unsigned 32-bit integers."""
        if len(text) <= PIECE_CHARS:
            return self._encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.concatenate([self._encoding.encode_to_numpy(p, disallowed_special=()) for p in pieces(text)]).astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes; they need not be valid UTF-8."""
        return self._encoding.decode_bytes(ids.tolist())


@cache
def codec(rank_file: str, pattern: str) -> Codec:
    """One codec per process and rank file."""
    return Codec(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``; ids is binary, four little-endian bytes per id."""
    rows = rows_of(docs, id_column, text_column)

    def run(batch: pa.RecordBatch):
        coder = codec(rank_file, pattern)
        for part in slices(batch, "text"):
            ids = [coder.encode(text) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The table of ``encode`` with the column ``decoded``, the raw bytes."""
    rows = encoded.select("doc_id", "n_tokens", "ids")

    def run(batch: pa.RecordBatch):
        coder = codec(rank_file, pattern)
        for part in slices(batch, "ids"):
            raw = [coder.decode(np.frombuffer(x or b"", dtype="<u4")) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, "decoded"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The table that ``decode`` gives of ``encode``, in one pass: ids are decoded where they are made."""
    rows = rows_of(docs, id_column, text_column)

    def run(batch: pa.RecordBatch):
        coder = codec(rank_file, pattern)
        for part in slices(batch, "text", 4 << 20):
            ids = [coder.encode(text) for text in part.column("text").to_pylist()]
            packed = pa.array([x.tobytes() for x in ids], pa.binary())
            decoded = pa.array([coder.decode(np.frombuffer(x.as_py(), dtype="<u4")) for x in packed], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), packed, decoded], names=["doc_id", "n_tokens", "ids", "decoded"]
            )

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the table of ``decode``."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
