"""Toxicity by a factorization machine over hashed terms.

A document is the set of the hashes of its lower-cased words. The score is the logistic of
bias + single weights + inner products of the vectors of all pairs of present terms, so an
insult next to a mention of a group can count for more than the two alone.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, those with the least hash of
their id. Terms enter it whose own rate differs between the labels, and terms that tell nothing
alone but together with another one: all terms of ``LEAST_ROWS`` rows or more are hashed into a
table of ``PAIR_BUCKETS``, and the labels of the rows that hold both of two buckets are held against
those of all rows and of either alone. Null, empty and wordless texts get the score of a document without terms; repeated rows repeat; an empty table
gives an empty one; rows of null id or label are not learned from; without labelled rows all
scores are the prior 1/2. Other columns are ignored, labels least of all read when scoring.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import WORD, WordCache, bounded, map_arrow, rows_of, slices

SAMPLE_ROWS, FACTORS, ROUNDS = 20_000, 8, 300
#: Least z score of a term's rate among positive against negative rows.
LEAST_Z = 5.0
#: Buckets of the table of pairs, least rows of a term and of a pair in it, least
#: z score of the labels of rows with both, and how much its square has to be above that of either.
PAIR_BUCKETS, LEAST_ROWS, LEAST_PAIR_Z, GAIN = 4096, 64, 10.0, 4.0
#: Rows and buckets of the table of pairs that are worked on at a time.
ROWS_AT_ONCE, BUCKETS_AT_ONCE = 1024, 256
THRESHOLD = 0.7


def _terms(text: str) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(w.encode()) for w in set(WORD.findall(text.lower()))), dtype=np.uint32))


def _interacting(at: np.ndarray, of: np.ndarray, rows_with: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which terms lie in a bucket that tells the labels apart together with another; ``at`` are terms, ``of`` their rows in order."""
    slot = np.where(rows_with >= LEAST_ROWS, np.arange(len(rows_with)) % PAIR_BUCKETS, -1)
    use = slot[at] >= 0
    n, rate = min(PAIR_BUCKETS, len(rows_with)), float(y.mean())
    row, bucket = of[use], slot[at][use].astype(np.int32)
    cuts = np.searchsorted(row, np.arange(0, len(y) + ROWS_AT_ONCE, ROWS_AT_ONCE))

    def tables() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, bucket) which rows have which buckets, some rows at a time, and which of the rows are positive."""
        for k, (low, high) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
            labels = y[k * ROWS_AT_ONCE : (k + 1) * ROWS_AT_ONCE] == 1
            x = np.zeros((len(labels), n), np.float32)
            x[row[low:high] - k * ROWS_AT_ONCE, bucket[low:high]] = 1
            yield x, labels

    def squares(both: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        return (toxic - both * rate) ** 2 / (np.maximum(both, 1) * rate * (1 - rate))

    alone = squares(*sum(np.stack([x.sum(0), x[labels].sum(0)]) for x, labels in tables()))
    telling = np.zeros(n, dtype=bool)
    for begin in range(0, n, BUCKETS_AT_ONCE):
        own = slice(begin, begin + BUCKETS_AT_ONCE)
        both = np.zeros((len(alone[own]), n), np.float32)
        toxic = np.zeros_like(both)
        for x, labels in tables():
            both += x[:, own].T @ x
            x = x[labels]
            toxic += x[:, own].T @ x
        tells = (both >= LEAST_ROWS) & ((z := squares(both, toxic)) >= LEAST_PAIR_Z**2) & (z >= GAIN * np.maximum(alone[own, None], alone))
        tells[np.arange(len(both)), begin + np.arange(len(both))] = False
        telling[own] = tells.any(1)
    return (slot >= 0) & telling[slot]


@dataclass(frozen=True)
class FactorizationMachine:
    """``terms`` sorted hashes; ``bias + w.x + sum over pairs of <v_i, v_j>``."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @staticmethod
    def fit(rows: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
        """Adam on the logistic loss with small L2 terms; equal rows of equal label count once."""
        once = {(row.tobytes(), int(y)): (row, int(y)) for row, y in zip(rows, labels, strict=True)}
        rows, y = [r for r, _ in once.values()], np.array([y for _, y in once.values()], dtype=np.float64)
        prior = (y.sum() + 1) / (len(y) + 2)
        bias = float(np.log(prior / (1 - prior)))
        none = FactorizationMachine(np.zeros(0, np.uint32), bias, np.zeros(0), np.zeros((0, FACTORS)))
        if not 0 < y.sum() < len(y):
            return none
        known, at = np.unique(np.concatenate(rows), return_inverse=True)
        at, of = at.astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        n1, n0 = y.sum(), len(y) - y.sum()
        c1 = np.bincount(at, weights=y[of], minlength=len(known))
        c = np.bincount(at, minlength=len(known))
        rate = c / len(y)
        z = (c1 / n1 - (c - c1) / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
        picked = np.flatnonzero((np.abs(z) >= LEAST_Z) & (c >= 5) | _interacting(at, of, c, y))
        if not len(picked):
            return none
        slot = np.full(len(known), -1)
        slot[picked] = np.arange(len(picked))
        use = slot[at] >= 0
        own, at = of[use], slot[at][use]  # the present terms, row by row
        sums = lambda values: np.bincount(at, weights=values, minlength=len(picked))
        rows_of = lambda values: np.bincount(own, weights=values, minlength=len(y))
        rng = np.random.default_rng(0)
        w, v, b = np.zeros(len(picked)), rng.normal(0, 0.05, (len(picked), FACTORS)), bias
        state = [np.zeros_like(p) for p in (w, w, v, v)] + [0.0, 0.0]
        for step in range(1, ROUNDS + 1):
            xv = np.stack([rows_of(v[at, f]) for f in range(FACTORS)], 1)
            s = b + rows_of((w - 0.5 * (v**2).sum(1))[at]) + 0.5 * (xv**2).sum(1)
            e = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(y)
            slope = sums(e[own])
            gw = slope + 1e-5 * w
            gv = np.stack([sums((e * xv[:, f])[own]) for f in range(FACTORS)], 1) - slope[:, None] * v + 1e-4 * v
            gb = e.sum()
            for i, (p, g) in enumerate(((w, gw), (v, gv))):
                m, u = state[2 * i], state[2 * i + 1]
                m += 0.1 * (g - m)
                u += 0.001 * (g * g - u)
                p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-9)
            state[4] += 0.1 * (gb - state[4])
            state[5] += 0.001 * (gb * gb - state[5])
            b -= 0.05 * (state[4] / (1 - 0.9**step)) / (np.sqrt(state[5] / (1 - 0.999**step)) + 1e-9)
        return FactorizationMachine(known[picked], float(b), w, v)

    def scores(self, texts: list[str], slots: dict[str, int]) -> np.ndarray:
        """Probabilities; ``slots`` maps words to places in ``terms`` or -1."""
        out, get = np.full(len(texts), self.bias), slots.__getitem__
        for i, text in enumerate(texts):
            have = set(map(get, set(WORD.findall(text.lower()))))
            have.discard(-1)
            if have:
                at = np.fromiter(sorted(have), dtype=np.int64)
                v = self.factors[at]
                out[i] += self.weights[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))

    def slots(self) -> WordCache:
        place = {int(t): i for i, t in enumerate(self.terms)}
        return WordCache(lambda word: place.get(zlib.crc32(word.encode()), -1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Learn from the labelled rows among ``labels``, in one task; at most ``sample_rows`` of them are broadcast and take part."""
    rated = labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    rated = rated.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = rows_of(docs, id_column, text_column).join(F.broadcast(rated), "doc_id").select("y", "text")

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "text"):
            found = [_terms(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(found, pa.binary())], names=["y", "terms"])

    def learn(batches):
        parts = pa.Table.from_batches(batches, pa.schema([("y", pa.int32()), ("terms", pa.binary())])).to_pandas()
        parts = parts.sort_values(["y", "terms"], kind="stable")
        model = FactorizationMachine.fit([np.frombuffer(t, np.uint32) for t in parts.terms], parts.y.to_numpy()) if len(parts) else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    fitted = map_arrow(rows, run, "y int, terms binary").repartition(1).mapInArrow(learn, "model binary").first()
    model = None if fitted is None else pickle.loads(fitted.model)
    return model or FactorizationMachine(np.zeros(0, np.uint32), 0.0, np.zeros(0), np.zeros((0, FACTORS)))


def score(docs: DataFrame, model: FactorizationMachine, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    rows = rows_of(docs, id_column, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        slots = own.slots()
        for batch in batches:
            for part in slices(batch, "text") if batch.num_rows else ():
                p = own.scores(part.column("text").to_pylist(), slots)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: FactorizationMachine, *, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        slots = own.slots()
        for batch in batches:
            for part in slices(batch, text_column) if batch.num_rows else ():
                yield part.filter(pa.array(own.scores([t or "" for t in part.column(text_column).to_pylist()], slots) < THRESHOLD))

    return bounded(docs).mapInArrow(run, docs.schema)
