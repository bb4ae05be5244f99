"""Toxicity, language and language-model scores: held-out accuracy and brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from samples import ODD, letters
from pyspark.sql import functions as F

from vicinal.llm import bpe, language, scoring, toxicity

RANKS = P.path("byte_bpe_50k.tiktoken")


def test_machine_learns_a_pair_that_no_weight_tells():
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([*("insult" for _ in [0] if a), *("group" for _ in [0] if b), letters(rng.randrange(500)), letters(1000 + rng.randrange(500))]))
        labels.append(int(a and b))
    model = toxicity.FactorizationMachine.fit([toxicity._terms(t) for t in texts], np.array(labels))
    p = model.scores(["insult alone", "group alone", "insult group"], model.slots())
    assert p[0] < 0.3 and p[1] < 0.3 and p[2] > 0.7


def test_machine_learns_a_pair_whose_terms_tell_nothing_alone():
    """Toxic is one term without the other: no weight of either says anything."""
    rng = random.Random(4)

    def made(n):
        rows = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(n)]
        return [" ".join(["insult"] * a + ["group"] * b + [letters(rng.randrange(2000)) for _ in range(20)]) for a, b in rows], np.array([int(a != b) for a, b in rows])

    texts, labels = made(6000)
    model = toxicity.FactorizationMachine.fit([toxicity._terms(t) for t in texts], labels)
    texts, labels = made(1000)
    assert np.mean((model.scores(texts, model.slots()) >= 0.7) == labels) > 0.98


def test_scores_by_brute_force(spark, make):
    """Bias, single weights and the product of every pair of present terms, one by one."""
    rng = np.random.default_rng(1)
    words = [letters(i) for i in range(30)]
    terms = np.sort(np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint32))
    model = toxicity.FactorizationMachine(terms, -0.4, rng.normal(size=30), rng.normal(size=(30, 8)) / 4)
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 12))).upper() + ", unknown 12 " + words[i] * (i % 2)) for i in range(20)] + [(90, None), (91, "x " * 9000 + words[3])]
    place = {int(t): i for i, t in enumerate(terms)}
    want = {}
    for i, text in texts:
        have = sorted({place[h] for w in (text or "").lower().replace(",", " ").split() if (h := zlib.crc32(w.encode())) in place})
        total = model.bias + sum(model.weights[a] for a in have) + sum(model.factors[a] @ model.factors[b] for a in have for b in have if a < b)
        want[i] = 1 / (1 + math.exp(-total))
    got = {r.doc_id: r for r in toxicity.score(make(texts), model).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(want)
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.fit(docs, labels.filter(rest != 1))
    rows = toxicity.score(docs, model).join(labels.filter(rest == 1), "doc_id").select("predicted", "toxic").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert sum(r.predicted > r.toxic for r in rows) <= 0.01 * len(rows)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (None, 1), (6, None), (2, 0)], "doc_id long, toxic int")
    for learn in (labels, labels.limit(0)):
        rows = toxicity.score(odd, toxicity.fit(odd, learn)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    model = toxicity.fit(none, labels)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.keep_clean(odd, model).count() == len(ODD)


def test_forward_backward_by_brute_force():
    rng = np.random.default_rng(0)
    emission, transition = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    gamma, pairs = language.forward_backward(emission, transition, lengths)
    assert np.allclose(gamma, language.marginals(emission, transition, lengths))
    seen = np.zeros((3, 3))
    for s, n in enumerate(lengths):
        paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
        w = np.array([sum(emission[t, s, p[t]] for t in range(n)) + sum(transition[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        for t in range(n):
            assert np.allclose([w[paths[:, t] == k].sum() for k in range(3)], gamma[t, s])
        for p, x in zip(paths, w, strict=True):
            for t in range(n - 1):
                seen[p[t], p[t + 1]] += x
    assert np.allclose(seen, pairs)


def plain_bucket(x, salt):
    x = (x + salt) * 0x9E3779B97F4A7C15 % 2**64
    return ((x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64) >> 46


def plain_features(word, lexicon):
    """The buckets of a word, letter by letter."""
    framed = [1, *map(ord, word), 2]
    out = [plain_bucket(a << 21 | b, 1) for a, b in zip(framed, framed[1:])]  # noqa: B905
    out += [plain_bucket((a << 42) + (b << 21) + c & 2**64 - 1, 2) for a, b, c in zip(framed, framed[1:], framed[2:])]  # noqa: B905
    own = xxhash.xxh64_intdigest(word.encode("utf-32-le"))
    out += [plain_bucket(own, 3), plain_bucket(0, 4)]
    for side, salt in ((word, 4), (word[::-1], 8)):
        key = 0
        for k, c in enumerate(side[:4], 1):
            key = (key * 0xC2B2AE3D27D4EB4F + ord(c)) % 2**64
            out.append(plain_bucket(key, salt + k))
    return out + [plain_bucket(int(j), 16) for h, row in zip(*lexicon, strict=True) if h == own for j in np.flatnonzero(row)]


def test_predictions_by_brute_force(spark, make):
    """Features word by word and sums over all paths give the scores of whole texts."""
    model = language.Crf.fit([("en", "the cat and the dog of the house".split() * 3), ("de", "der hund und die katze der stadt".split() * 3), ("es", "el perro y la casa".split() * 3)])
    texts = [(1, "The cat und"), (2, "la Casa, dog!"), (3, "zzz 1 ñandú ☃ the"), (4, "y"), (5, "12")]
    got = {r.doc_id: r for r in language.predict(make(texts), model).collect()}
    for i, text in texts:
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        if not words:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        emission = np.array([[model.weights[j][plain_features(w, model.lexicon)].sum(dtype=float) for j in range(3)] for w in words])
        paths = np.array(np.meshgrid(*[range(3)] * len(words), indexing="ij")).reshape(len(words), -1).T
        worth = np.exp([sum(emission[t, p[t]] for t in range(len(words))) + sum(model.transition[a, b] for a, b in zip(p, p[1:])) for p in paths])  # noqa: B905
        mean = np.array([sum(worth[paths[:, t] == j].sum() for t in range(len(words))) for j in range(3)]) / worth.sum() / len(words)
        assert got[i].lang_pred == model.labels[int(mean.argmax())] and got[i].score == pytest.approx(mean.max(), abs=1e-4)


def test_every_word_of_the_sample_is_learned_from():
    rng = np.random.default_rng(2)
    spoken = [rng.integers(0, 9999, 1234), rng.integers(10_000, 12_000, 777)]
    ids, gold = language._sequences(spoken, rng)
    assert set(ids.ravel()) == set(np.concatenate(spoken)) and ((ids >= 10_000) == gold).all()
    assert (gold.min(1) != gold.max(1)).sum() > 0.2 * len(gold)


def test_long_texts_are_learned_from_whole_and_within_the_bound(spark, make):
    texts = [(1, "alpha " * 3000 + "omega " * 50), (2, "beta " * 10), (3, "gamma " * 5000)]
    model = language.fit(make(texts))
    known = set(model.lexicon[0].tolist())
    assert all(xxhash.xxh64_intdigest(w.encode("utf-32-le")) in known for w in ("alpha", "omega", "beta", "gamma"))
    assert 1 <= len(language.fit(make(texts), sample_chars=100).lexicon[0]) <= 2


def test_language_held_out_and_switched(spark, make, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language.fit(docs.filter(rest != 2), sample_docs=1500)
    rows = language.predict(docs.filter(rest == 2), model).join(docs, "doc_id").select("lang_pred", "lang").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    en, fr = ("the and of that with this from have which there these being", "les des avec pour dans une est que sont aux pas sur")
    row = language.tag_words(make([(1, f"{en} {fr}")]), model).first()
    assert row.langs[:10].count("en") >= 8 and row.langs[-10:].count("fr") >= 8
    got = {r.doc_id: r for r in language.predict(make(ODD), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[7].lang_pred == "und" and got[7].score == 0
    assert language.predict(none, model).count() == 0
    assert language.predict(make(ODD), language.fit(none)).filter("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("hot", [10**6, 40, 3, 0])
def test_losses_by_brute_force(spark, make, odd, hot):
    """Losses of all bigrams broadcast, of the frequent ones, of none."""
    texts = [(1, "the cat sat on the mat. the cat ran"), (2, "a dog sat on the log"), (3, "pure other words here"), (3, "pure other words here"), *ODD]
    docs, target = make(texts), spark.createDataFrame([(1,), (3,), (3,), (None,)], "doc_id long")
    coder, v = bpe.codec(RANKS, P.PATTERN), 50256
    ids = [(i, [v, *coder.encode(t or "").tolist()]) for i, t in texts]

    def model(keep):
        pairs = Counter(p for i, x in ids if keep(i) for p in zip(x, x[1:]))  # noqa: B905
        words, contexts, kinds = Counter(), Counter(), Counter()
        for (a, b), n in pairs.items():
            words[b] += n
            contexts[a] += n
            kinds[a] += 1
        total = sum(words.values())

        def loss(a, b):
            u = (words[b] + 1) / (total + v)
            return -math.log((pairs[a, b] + kinds[a] * u) / (contexts[a] + kinds[a]) if contexts[a] else u)

        return loss

    t, b = model(lambda i: i in (1, 3)), model(lambda i: True)
    want = sorted((i or 0, len(x) - 1, sum(b(*p) - t(*p) for p in zip(x, x[1:])) / max(1, len(x) - 1)) for i, x in ids)  # noqa: B905
    _, table = scoring.losses(docs, target, RANKS, P.PATTERN, v)
    counts, cut = [r.n for r in table.collect()], scoring._cut(table, hot)
    assert (cut == 1) == (len(counts) <= hot) and sum(n >= cut for n in counts) <= hot
    assert cut == 1 or sum(n >= cut // 2 for n in counts) > hot
    got = sorted((r.doc_id or 0, r.n_tokens, r.score) for r in scoring.score(docs, target, RANKS, P.PATTERN, v, hot_entries=hot).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-5)


def test_losses_of_nothing(spark, none, odd):
    empty = spark.createDataFrame([], "doc_id long")
    assert scoring.score(none, empty, RANKS, P.PATTERN, 50256).count() == 0
    assert scoring.score(odd, empty, RANKS, P.PATTERN, 50256).count() == len(ODD)
