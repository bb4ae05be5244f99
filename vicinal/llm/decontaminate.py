"""Benchmark decontamination: CGK embedding, bit-sampling LSH, pieces of items, exact edit verification.

Texts are sequences of lower-cased words. The CGK walk reads a sequence with random steps
that depend on the word read and the step, the same for all sequences: it repeats a word or
goes on. Sequences a few edits apart give walks that agree in most places. Windows of the
documents are walked as far as a benchmark item of their size class reaches; ``REPEATS`` keys
of ``SAMPLED`` walk places each are looked up among the keys of the items. A window of a
document begins at every n-th word only: the items are walked from every word that leaves a
window, so one of their windows meets it. Short walks have too few places for keys that differ,
and no walk meets every edited item: items of fewer than ``WALKED_WORDS`` words are not walked,
and every item is also cut into one piece more than it may have edits. One piece at least is
whole in any edited copy, so looking up the pieces misses no item. A match of keys or of a piece
is a candidate; an item counts as found where its edit distance, in words, to a part of the
document is at most ``1 - least`` of its length. Verification is exact, so clean documents stay
clean.

Words are compared by hashes until a find is confirmed by the words themselves. Items that may
have no edit, those of fewer than five words at the usual limit, are looked up whole: an item of
one word is found wherever that word is. Items go to the executors in blocks of ``BLOCK_BYTES`` of
text; one scan of the documents serves all blocks. Items without a word are in no text. Null and
empty texts hold no item; repeated rows repeat; empty tables give an empty one; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vicinal.llm.common import bounded, rows_of, runs, slices, word_hashes

LEAST, SAMPLED, REPEATS, GAP = 0.8, 4, 128, 3
BLOCK_BYTES = 4 << 20
#: Bytes of texts that are searched before the next block of items has its turn, if there are several.
TURN_BYTES = 64 << 20
#: Items of fewer words than this have no walks, only pieces.
WALKED_WORDS = 22
_BITS = 17


# Bytes that words are made of: ASCII letters and digits, and all of other characters.
_WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_NO_WORD = re.compile(r"[^\x00-\x7f\w]+")


class Numbered:
    """The words of some texts, lower-cased letters and digits, as hashes; 0 is kept for the end of a text."""

    def __init__(self, texts: list[str | None]):
        lower = [(t or "").lower() for t in texts]
        parts = [(t if t.isascii() else _NO_WORD.sub(" ", t)).encode("utf-8", "surrogatepass") for t in lower]
        self._raw = np.frombuffer(b" ".join(parts), dtype=np.uint8)
        self._starts, self._ends = runs(_WORD_BYTES[self._raw])
        ids = np.maximum(word_hashes(self._raw, self._starts, self._ends), np.uint64(1))
        cuts = np.searchsorted(self._starts, np.cumsum([len(p) + 1 for p in parts])[:-1])
        self._first = [0, *cuts.tolist()]
        self.ids = np.split(ids, cuts)

    def words(self, text: int, low: int, high: int) -> list[bytes]:
        """The words of a text from place ``low`` to ``high``."""
        at = slice(self._first[text] + low, self._first[text] + min(high, len(self.ids[text])))
        return [self._raw[a:b].tobytes() for a, b in zip(self._starts[at].tolist(), self._ends[at].tolist(), strict=True)]


def word_id(word: str) -> int:
    """The number of one word."""
    return int(Numbered([word]).ids[0][0])


def edit_allowance(n: int, least: float = LEAST) -> int:
    return math.floor((1 - least) * n + 1e-9)


def best_match(item: list, text: list) -> tuple[int, int]:
    """Least edit distance of the item to a part of the text, and where that part ends (bit-parallel, exact)."""
    places: dict = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    n, whole = len(item), (1 << len(item)) - 1
    plus, minus, score, top = whole, 0, n, 1 << (n - 1)
    best, end = n, 0
    for j, w in enumerate(text):
        eq = places.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(xh | plus) & whole), plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & whole, down << 1 & whole  # a match may begin anywhere in the text
        plus, minus = down | (~(xv | up) & whole), up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass(frozen=True)
class SizeClass:
    """Items of ``low`` to ``high - 1`` words: stride of the windows, steps of the walk."""

    low: int
    high: int

    @property
    def stride(self) -> int:
        return max(1, self.low // 5)

    @property
    def window(self) -> int:
        return self.low - self.stride + 1

    @property
    def steps(self) -> int:
        """So many that the walk seldom leaves the window: its mean and 2.4 deviations are within."""
        s = 1
        while (s + 1) / 2 + 1.2 * math.sqrt(s + 1) <= self.window:
            s += 1
        return s


def size_class(n: int) -> SizeClass:
    low = 5
    while (high := max(low + 2, low * 3 // 2)) <= n:
        low = high
    return SizeClass(low, high)


def walk(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int) -> np.ndarray:
    """(step, window) the low halves of the words that the CGK walks read; past the end they read 0."""
    out = np.empty((steps, len(starts)), dtype=np.uint32)
    at = starts.astype(np.int64)
    mixed = ids
    low = ids.astype(np.uint32)
    for j in range(steps):
        if j and j % 64 == 0:
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        out[j] = low[at]
        at += ((mixed[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        np.minimum(at, ends, out=at)
    return out


def _samples(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each repetition, ``GAP`` apart as neighbours often read the same word, and factors for their sum."""
    rng = np.random.default_rng(steps)
    k = min(SAMPLED, steps)
    gap = max(1, min(GAP, (steps - 1) // max(1, k - 1)))
    free = steps - (k - 1) * (gap - 1)
    places = np.stack([np.sort(rng.choice(free, k, replace=False)) + np.arange(k) * (gap - 1) for _ in range(REPEATS)])
    return places, rng.integers(1, 1 << 31, (REPEATS, k), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _keys(walked: np.ndarray, places: np.ndarray, factors: np.ndarray) -> np.ndarray:
    key = walked[places[0]] * factors[0]
    for p, f in zip(places[1:], factors[1:], strict=True):
        key += walked[p] * f
    key ^= key >> np.uint32(15)
    return key * np.uint32(2654435761)


def _pieces(n: int, least: float) -> list[tuple[int, int]]:
    """Start and size of the pieces of an item of n words, one more than it may have edits."""
    cuts = [i * n // (k + 1) for k in (min(edit_allowance(n, least), n - 1),) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def _runs_of(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    key = ids[: max(0, len(ids) - size + 1)].copy()
    for i in range(1, size):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key += ids[i : i + len(key)]
    return key ^ key >> np.uint64(32)


class ItemIndex:
    """Keys of a block of items, by size class and repetition, and their pieces by size."""

    def __init__(self, items: list[tuple[object, str]], least: float = LEAST):
        self.names = [name for name, _ in items]
        numbered = Numbered([text for _, text in items])
        self.words = [ids.tolist() for ids in numbered.ids]
        self.spelled = [numbered.words(i, 0, len(ids)) for i, ids in enumerate(self.words)]
        self.sets = [set(words) for words in self.words]
        self.least = least
        members: dict[SizeClass, list[int]] = {}
        for i, words in enumerate(self.words):
            if len(words) >= WALKED_WORDS and edit_allowance(len(words), least):
                members.setdefault(size_class(len(words)), []).append(i)
        self.classes = []
        for kind, own in sorted(members.items(), key=lambda x: x[0].low):
            at = [(i, o) for i in own for o in range(len(self.words[i]) - kind.window + 1)]
            flat, base = [], {}
            for i in own:
                base[i] = len(flat)
                flat += [*self.words[i], 0]
            ids = np.array(flat, dtype=np.uint64)
            starts = np.array([base[i] + o for i, o in at])
            ends = np.array([base[i] + len(self.words[i]) for i, _ in at])
            walked = walk(ids, starts, ends, kind.steps)
            places, factors = _samples(kind.steps)
            tables = []
            for p, f in zip(places, factors, strict=True):
                keys = _keys(walked, p, f)
                order = np.argsort(keys, kind="stable")
                seen = np.zeros(1 << _BITS, dtype=bool)
                seen[keys >> np.uint32(32 - _BITS)] = True
                tables.append((p, f, seen, keys[order], order))
            self.classes.append((kind, np.array(at), tables))
        cut: dict[int, list[tuple[int, int, int]]] = {}
        whole: dict[int, list[tuple[int, int, int]]] = {}
        for i, words in enumerate(self.words):
            ids = np.array(words, dtype=np.uint64)
            table = cut if edit_allowance(len(words), least) else whole
            for start, size in _pieces(len(words), least) if words else ():
                table.setdefault(size, []).append((int(_runs_of(ids[start : start + size], size)[0]), i, start))
        self.pieces, self.whole = self._lookups(cut), self._lookups(whole)

    @staticmethod
    def _lookups(tables: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, np.uint64, np.ndarray, np.ndarray, np.ndarray]]:
        """For each size of runs: a mask, which masked keys there are, the sorted keys, and the item and place of each."""
        out = []
        for size, own in sorted(tables.items()):
            own.sort()
            keys = np.array([key for key, *_ in own], dtype=np.uint64)
            mask = np.uint64((1 << min(24, max(_BITS, len(own).bit_length() + 5))) - 1)
            seen = np.zeros(int(mask) + 1, dtype=bool)
            seen[keys & mask] = True
            out.append((size, mask, seen, keys, np.array([at for _, *at in own])))
        return out

    @staticmethod
    def _hits(ids: np.ndarray, lookup: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Places of texts where a run of a lookup begins, and the number of the lookup's entry."""
        size, mask, seen, keys, _ = lookup
        own = _runs_of(ids, size)
        hit = np.flatnonzero(seen[own & mask])
        first, last = np.searchsorted(keys, own[hit], "left"), np.searchsorted(keys, own[hit], "right")
        times = last - first
        return np.repeat(hit, times), np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(item, place where it would begin) for texts written after each other, each ended by a 0."""
        out: set[tuple[int, int]] = set()
        for kind, at, tables in self.classes:
            starts = np.arange(0, len(ids), kind.stride)
            starts = starts[ends[starts] - starts >= kind.window - edit_allowance(kind.window, self.least)]
            for begin in range(0, len(starts), 1 << 16):
                some = starts[begin : begin + (1 << 16)]
                walked = walk(ids, some, ends[some], kind.steps)
                for p, f, seen, keys, order in tables:
                    own = _keys(walked, p, f)
                    hit = np.flatnonzero(seen[own >> np.uint32(32 - _BITS)])
                    if not len(hit):
                        continue
                    first, last = np.searchsorted(keys, own[hit], "left"), np.searchsorted(keys, own[hit], "right")
                    for h, a, b in zip(*(x[last > first].tolist() for x in (hit, first, last)), strict=True):
                        for item, offset in at[order[a:b]].tolist():
                            out.add((item, int(some[h]) - offset))
        for lookup in self.pieces:
            hit, entry = self._hits(ids, lookup)
            item, offset = lookup[-1][entry].T
            out.update(zip(item.tolist(), (hit - offset).tolist(), strict=True))
        return out

    def _verbatim(self, ids: np.ndarray, bases: np.ndarray, words: Callable[[int, int, int], list[bytes]] | None) -> Iterator[tuple[int, int, int]]:
        """(text, item, first word) of the items that may have no edit, at their first place in each text."""
        for lookup in self.whole:
            hit, entry = self._hits(ids, lookup)
            item, text = lookup[-1][entry, 0], np.searchsorted(bases, hit, "right") - 1
            order = np.lexsort((hit, item, text))
            done = None
            for i in order[np.diff(text[order] * len(self.names) + item[order], prepend=-1) > 0] if words is None else order:
                found = int(text[i]), int(item[i])
                at = int(hit[i] - bases[found[0]])
                if found != done and (words is None or words(found[0], at, at + lookup[0]) == self.spelled[found[1]]):
                    done = found
                    yield *found, at

    def search(self, texts: list[np.ndarray], words: Callable[[int, int, int], list[bytes]] | None = None) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, words) of every item that a text holds; the best place of each.

        ``words`` gives the words of a text between two places; finds are then confirmed by them.
        """
        if not texts:
            return []
        sizes = np.array([len(t) + 1 for t in texts])
        bases = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.zeros(bases[-1], dtype=np.uint64)
        for base, t in zip(bases, texts):  # noqa: B905
            ids[base : base + len(t)] = t
        ends = np.repeat(bases[1:] - 1, sizes)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, first in self._verbatim(ids, bases, words):
            found[text, item] = (0, first, len(self.words[item]))
        looked: set[tuple[int, int, int]] = set()
        for item, start in sorted(self.candidates(ids, ends)):
            own_words, own = self.words[item], self.sets[item]
            slack = edit_allowance(len(own_words), self.least)
            text = int(np.searchsorted(bases, min(max(start + slack, 0), len(ids) - 1), "right")) - 1
            for near in {text, int(np.searchsorted(bases, max(start, 0), "right")) - 1, int(np.searchsorted(bases, min(max(start + len(own_words) - 1, 0), len(ids) - 1), "right")) - 1}:
                low = max(start - slack, int(bases[near]))
                high = min(start + len(own_words) + slack, int(bases[near + 1]) - 1)
                if high - low < len(own_words) - slack or (near, item, start) in looked:
                    continue
                looked.add((near, item, start))
                part = ids[low:high].tolist()
                if len(own.intersection(part)) < len(own) - slack:  # an edit takes away one word at most
                    continue
                distance, end = best_match(own_words, part)
                low -= int(bases[near])
                best = found.get((near, item), (slack + 1, 0, 0))
                if words is not None and distance <= min(slack, best[0]):
                    distance, end = best_match(self.spelled[item], words(near, low, low + len(part)))
                if distance <= slack:
                    first = max(0, low + end - len(own_words))
                    found[near, item] = min(best, (distance, first, low + end - first))
        return [(text, item, *best) for (text, item), best in sorted(found.items())]


def item_blocks(benchmark: DataFrame, id_column: str, text_column: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_column).alias("item_id"), F.col(text_column).cast("string").alias("text")).filter("text is not null")
    for row in rows.toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text) + 64
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


class Searcher:
    """All blocks of items at work in one task; the index of the last block is kept, so that of a single one is made once."""

    def __init__(self, blocks: list[Broadcast], least: float):
        self._blocks, self._least, self._held = blocks, least, (-1, None)

    def _index(self, i: int) -> ItemIndex:
        if self._held[0] != i:
            self._held = i, ItemIndex(self._blocks[i].value, self._least)
        return self._held[1]

    def __call__(self, batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        """Parts of the batches, each with (row, name of the item, distance, first word, words) of its finds."""
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, column, 2 << 20) if batch.num_rows else ():
                held.append(part)
                size += part.column(column).nbytes
                if len(self._blocks) == 1 or size >= TURN_BYTES:
                    yield from self._searched(held, column)
                    held, size = [], 0
        yield from self._searched(held, column)

    def _searched(self, parts: list[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found: list[list[tuple]] = [[] for _ in parts]
        numbered = [Numbered(part.column(column).to_pylist()) for part in parts] if self._blocks else []
        for i in range(len(self._blocks) if parts else 0):
            index = self._index(i)
            for own, texts in zip(found, numbered, strict=True):
                own += [(row, index.names[item], *place) for row, item, *place in index.search(texts.ids, texts.words)]
        yield from zip(parts, found, strict=True)


def _shared(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str) -> list[Broadcast]:
    return [docs.sparkSession.sparkContext.broadcast(block) for block in item_blocks(benchmark, id_column, text_column, BLOCK_BYTES)]


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, least: float = LEAST, *, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; one pass over them."""
    blocks = _shared(docs, benchmark, item_column, item_text_column)

    def run(batches):
        for part, found in Searcher(blocks, least)(batches, text_column):
            keep = np.ones(part.num_rows, dtype=bool)
            keep[[row for row, *_ in found]] = False
            yield part.filter(pa.array(keep))

    return bounded(docs).mapInArrow(run, docs.schema)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = LEAST,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """``doc_id, item_id, distance, first_word, words``: the items that documents hold, and the best place of each."""
    rows = rows_of(docs, id_column, text_column)
    kinds = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_column].dataType)
    blocks = _shared(docs, benchmark, item_column, item_text_column)

    def run(batches):
        for part, found in Searcher(blocks, least)(batches, "text"):
            names = part.column("doc_id").to_pylist() if found else []
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in columns[0]], part.column("doc_id").type),
                    pa.array(columns[1], item_type),
                    *(pa.array(c, pa.int32()) for c in columns[2:]),
                ],
                names=["doc_id", "item_id", "distance", "first_word", "words"],
            )

    return rows.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, first_word int, words int")
