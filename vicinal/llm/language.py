"""Language of words and texts by a linear-chain conditional random field.

Features of a word: itself, its prefixes and suffixes of one to four letters, its two- and
three-letter sequences, and whether the lexicon of a language holds it. They are hashed into
one weight table. Transitions between the languages of neighbouring words are learned from
sequences spliced from texts of several languages. Forward-backward gives each word the
probabilities of the languages; a text's score for a language is their mean.

The model is fitted on the whole texts of at most ``SAMPLE_DOCS`` documents, those with the least
hash of their id, as many as have ``SAMPLE_CHARS`` code points together (one at least). A null text, or one without a letter, is ``und`` with score 0, and so is
every text if there is nothing to learn from. Repeated rows repeat; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import bounded, distinct_words, map_arrow, rows_of, runs, slices, word_hashes

SAMPLE_DOCS, SAMPLE_CHARS, SEGMENT, BUCKETS, AFFIX = 4_000, 64 << 20, 40, 1 << 18, 4
#: Sequences that training sees at least, passing over the sample as often as that takes, and those of one step.
SEQUENCES, STEP = 24_000, 400
#: Words of a batch of sequences that forward-backward takes at once.
GROUP_WORDS = 400_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Words:
    """The words of some texts: runs of letters, lower-cased; ``per_text`` counts them."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        self.text = "\n".join(lower)
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.starts, self.ends = runs(_letters()[self.codes])
        bounds = np.searchsorted(self.starts, np.cumsum([len(t) + 1 for t in lower]))
        self.per_text = np.diff(bounds, prepend=0)

    def listed(self) -> list[list[str]]:
        flat = [self.text[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        ends = np.cumsum(self.per_text).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(46)).astype(np.int64)


def features(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and the number of the word that each belongs to."""
    sizes = ends - starts
    n, base = len(sizes), np.cumsum(sizes + 2) - (sizes + 2)
    owner = np.repeat(np.arange(n), sizes + 2)
    framed = np.zeros(len(owner), dtype=np.uint64)  # every word between a 1 and a 2
    framed[base], framed[base + sizes + 1] = 1, 2
    inner = np.repeat(base + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    framed[inner] = codes[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
    two = framed[:-1] * np.uint64(1 << 21) + framed[1:]
    three = two[:-1] * np.uint64(1 << 21) + framed[2:]
    in_two, in_three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    flat = [_bucket(two[in_two], 1), _bucket(three[in_three], 2), _bucket(hashes, 3), _bucket(np.zeros(n, dtype=np.uint64), 4)]
    owners = [owner[:-1][in_two], owner[:-2][in_three], np.arange(n), np.arange(n)]
    before, after = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for k in range(1, AFFIX + 1):
        long = np.flatnonzero(sizes >= k)
        before[long] = before[long] * np.uint64(0xC2B2AE3D27D4EB4F) + framed[base[long] + k]
        after[long] = after[long] * np.uint64(0xC2B2AE3D27D4EB4F) + framed[base[long] + sizes[long] + 1 - k]
        flat += [_bucket(before[long], 4 + k), _bucket(after[long], 8 + k)]
        owners += [long, long]
    known, of = lexicon
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        word, label = np.nonzero(of[at] & (known[at] == hashes)[:, None])
        flat.append(_bucket(label.astype(np.uint64), 16))
        owners.append(word)
    return np.concatenate(flat), np.concatenate(owners)


def forward_backward(emission: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (time, sequence, label) and expected transition counts.

    ``emission`` is (time, sequence, label) in logarithms; sequences are sorted by falling length.
    """
    steps, n, k = emission.shape
    move = np.exp(transition - transition.max())
    local = np.exp(emission - emission.max(axis=2, keepdims=True))
    alive = (lengths[None, :] > np.arange(steps)[:, None]).sum(1)
    ahead = np.zeros_like(local)
    ahead[0] = local[0] / local[0].sum(1, keepdims=True)
    for t in range(1, steps):
        a = alive[t]
        step = ahead[t - 1, :a] @ move * local[t, :a]
        ahead[t, :a] = step / step.sum(1, keepdims=True)
    gamma, pairs = np.zeros_like(local), np.zeros((k, k))
    back = np.ones((n, k))
    for t in range(steps - 1, -1, -1):
        a = alive[t]
        if t + 1 < steps and alive[t + 1]:
            b = alive[t + 1]
            message = local[t + 1, :b] * back[:b]
            joint = ahead[t, :b, :, None] * move * message[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            sent = message @ move.T
            back[:b] = sent / sent.sum(1, keepdims=True)
        g = ahead[t, :a] * back[:a]
        gamma[t, :a] = g / g.sum(1, keepdims=True)
    return gamma, pairs


def marginals(emission: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """As ``forward_backward``, without the transition counts."""
    steps, n, k = emission.shape
    move = np.exp(transition - transition.max())
    back_move = np.ascontiguousarray(move.T)
    local = np.exp(emission - emission.max(axis=2, keepdims=True))
    alive = (lengths[None, :] > np.arange(steps)[:, None]).sum(1).tolist()
    ahead = np.zeros_like(local)
    ahead[0] = local[0]
    for t in range(1, steps):
        a = alive[t]
        step = ahead[t - 1, :a] @ move
        step *= local[t, :a]
        step /= step.sum(1, keepdims=True)
        ahead[t, :a] = step
    back = np.ones((n, k))
    for t in range(steps - 2, -1, -1):
        b = alive[t + 1]
        sent = (local[t + 1, :b] * back[:b]) @ back_move
        sent /= sent.sum(1, keepdims=True)
        back[:b] = sent
        ahead[t, :b] *= sent
    total = ahead.sum(2, keepdims=True)
    np.divide(ahead, total, out=ahead, where=total > 0)
    return ahead


@dataclass(frozen=True)
class Crf:
    """Labels, (label, bucket) feature weights, transition weights, and the lexicons: sorted hashes and the labels of each."""

    labels: tuple[str, ...]
    weights: np.ndarray
    transition: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def fit(texts: list[tuple[str, list[str]]], seed: int = 0) -> Crf:
        """Learn from word lists of known language. Every word is learned from in every pass.

        Half of a pass are sequences of one language, the other half is spliced from pieces of all.
        Languages with fewer words than the mean are repeated up to it.
        """
        texts = [(lang, words) for lang, words in texts if words]
        labels = tuple(sorted({lang for lang, _ in texts}))
        k = len(labels)
        if not k:
            return Crf((), np.zeros((0, BUCKETS), np.float32), np.zeros((0, 0)), (np.zeros(0, np.uint64), np.zeros((0, 0), bool)))
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in texts for w in words}))}
        spoken = [np.array([vocabulary[w] for lang, words in texts if lang == label for w in words]) for label in labels]
        counts = np.stack([np.bincount(x, minlength=len(vocabulary)) for x in spoken], 1)
        total = counts.sum(1)
        all_words = Words(list(vocabulary))
        hashes = word_hashes(all_words.codes, all_words.starts, all_words.ends)
        common = np.flatnonzero(total >= 5)
        common = common[np.argsort(hashes[common])]
        lexicon = hashes[common], counts[common] >= 0.2 * total[common, None]
        flat, owner = features(all_words.codes, all_words.starts, all_words.ends, hashes, lexicon)
        order = np.argsort(owner, kind="stable")
        flat, sizes = flat[order], np.bincount(owner, minlength=len(vocabulary))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        rng = np.random.default_rng(seed)
        mean = sum(map(len, spoken)) // k
        spoken = [np.resize(x, max(len(x), mean, SEGMENT)) for x in spoken]
        rounds = -(-SEQUENCES * SEGMENT // sum(map(len, spoken)))
        ids, gold = (np.concatenate(x) for x in zip(*(_sequences(spoken, rng) for _ in range(rounds)), strict=True))
        weights, transition = np.zeros((k, BUCKETS), np.float32), np.zeros((k, k))
        squares, moves = np.full((k, BUCKETS), 1e-6, np.float32), np.full((k, k), 1e-6)
        lengths, one = np.full(STEP, SEGMENT), np.eye(k)
        for begin in range(0, len(ids), STEP):
            some = slice(begin, begin + STEP)
            words, at = np.unique(ids[some], return_inverse=True)
            at = at.reshape(-1, SEGMENT)
            own = np.repeat(np.arange(len(words)), sizes[words])
            span = flat[np.repeat(starts[words] - (np.cumsum(sizes[words]) - sizes[words]), sizes[words]) + np.arange(len(own))]
            scores = _sums(weights, span, own, len(words))
            gamma, pairs = forward_backward(scores[at].transpose(1, 0, 2), transition, lengths[: len(at)])
            error = gamma.transpose(1, 0, 2) - one[gold[some]]
            slope = np.empty_like(weights)
            for j in range(k):
                per_word = np.bincount(at.ravel(), weights=error[..., j].ravel(), minlength=len(words)) / len(at)
                slope[j] = np.bincount(span, weights=per_word[own], minlength=BUCKETS)
            slope += 1e-5 * weights
            squares += slope**2
            weights -= 0.1 * slope / np.sqrt(squares)
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[some][:, :-1].ravel(), gold[some][:, 1:].ravel()), 1)
            turn = (pairs - seen) / len(at)
            moves += turn**2
            transition -= 0.1 * turn / np.sqrt(moves)
        return Crf(labels, weights, transition, lexicon)


def _sequences(spoken: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, word) words and languages of one pass over all words, in random order.

    The words of a language are cut into rows of ``SEGMENT``, the last filled up from the beginning. Half
    of the rows stay; the others are cut into pieces of 4 to 19 words, which are shuffled and laid end to end.
    """
    rows = [np.resize(x, (-(-len(x) // SEGMENT), SEGMENT)) for x in spoken]
    ids, gold = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = rng.permutation(len(ids))
    ids, gold = ids[order], np.repeat(gold[order, None], SEGMENT, 1)
    half = len(ids) // 2
    mixed, told = ids[half:].ravel(), gold[half:].ravel()
    cut = np.cumsum(rng.integers(4, 20, len(mixed) // 4 + 1))
    cut = np.unique(np.concatenate([cut[cut < len(mixed)], np.arange(SEGMENT, len(mixed), SEGMENT)]))
    begin, size = np.concatenate([[0], cut]), np.diff(cut, prepend=0, append=len(mixed))
    turn = rng.permutation(len(begin))
    size = size[turn]
    at = np.repeat(begin[turn] - (np.cumsum(size) - size), size) + np.arange(len(mixed))
    ids[half:], gold[half:] = mixed[at].reshape(-1, SEGMENT), told[at].reshape(-1, SEGMENT)
    order = rng.permutation(len(ids))
    return ids[order], gold[order]


def _sums(weights: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(word, label) sums of the weights of the words' features."""
    return np.stack([np.bincount(owner, weights=w[flat], minlength=n) for w in weights], 1)


class Tagger:
    """A model at work: each distinct word of some texts is scored once."""

    def __init__(self, model: Crf):
        self.model = model

    def tag(self, words: Words) -> list[np.ndarray]:
        """(word, label) probabilities of every text."""
        k, ends = len(self.model.labels), np.cumsum(words.per_text)
        out: list[np.ndarray] = [np.zeros((n, k)) for n in words.per_text.tolist()]
        if not k or not len(words.starts):
            return out
        distinct, of = distinct_words(words.codes, words.starts, words.ends)
        first = np.zeros(len(distinct), dtype=np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
        flat, owner = features(words.codes, words.starts[first], words.ends[first], hashes, self.model.lexicon)
        scores = _sums(self.model.weights, flat, owner, len(distinct)).astype(np.float32)
        order = np.argsort(-words.per_text, kind="stable")
        order = order[words.per_text[order] > 0].tolist()
        while order:
            longest = int(words.per_text[order[0]])
            n = max(1, GROUP_WORDS // longest)
            group, order = order[:n], order[n:]
            lengths = words.per_text[group]
            emission = np.zeros((longest, len(group), k))
            step, text = np.arange(longest)[:, None] < lengths, np.array(group)
            at = (ends[text] - lengths)[None, :] + np.arange(longest)[:, None]
            emission[step] = scores[of[at[step]]]
            gamma = marginals(emission, self.model.transition, lengths)
            for j, i in enumerate(group):
                out[i] = gamma[: lengths[j], j]
        return out


def fit(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS
) -> Crf:
    """Learn from rows with a language; the whole texts of the sampled documents are collected, each word once lower-cased."""
    known = bounded(docs).select(F.col(id_column).alias("doc_id"), F.col(lang_column).alias("lang"), F.col(text_column).cast("string").alias("text"))
    known = known.filter("doc_id is not null and lang is not null and text is not null")
    ids = known.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    before = F.coalesce(F.sum("chars").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = ids.select("doc_id", before.alias("before"), "chars").filter((F.col("before") == 0) | (F.col("before") + F.col("chars") <= sample_chars)).select("doc_id")
    rows = known.join(F.broadcast(ids), "doc_id").select("lang", "text")

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "text"):
            words = [" ".join(w) for w in Words(part.column("text").to_pylist()).listed()]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(words, pa.string())], names=["lang", "words"])

    sample = map_arrow(rows, run, "lang string, words string").toArrow().to_pandas().drop_duplicates().sort_values(["lang", "words"], kind="stable")
    return Crf.fit([(lang, words.split(" ")) for lang, words in sample.itertuples(index=False) if words])


def predict(docs: DataFrame, model: Crf, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the language with the largest mean probability over a text's words."""
    rows = rows_of(docs, id_column, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger = Tagger(shared.value)
        labels = np.array([*shared.value.labels, UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20) if batch.num_rows else ():
                found = [g.mean(0) if len(g) and len(labels) > 1 else None for g in tagger.tag(Words(part.column("text").to_pylist()))]
                langs = [labels[-1] if g is None else labels[int(g.argmax())] for g in found]
                scores = [0.0 if g is None else float(min(1.0, g.max())) for g in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def tag_words(docs: DataFrame, model: Crf, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, words, langs``: the likeliest language of every word that has a letter."""
    rows = rows_of(docs, id_column, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20) if batch.num_rows else ():
                found = Words(part.column("text").to_pylist())
                words = found.listed()
                tags = [[shared.value.labels[i] for i in g.argmax(1)] if g.shape[1] else [UNKNOWN] * len(w) for g, w in zip(tagger.tag(found), words, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.string()))], names=["doc_id", "words", "langs"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, words array<string>, langs array<string>")
