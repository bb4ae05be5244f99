import hashlib
import random
import re

import pytest
from samples import ODD, letters
from pyspark.sql import functions as F

from vicinal.llm import spotsigs


def found(docs):
    table = spotsigs.compare_edited(docs)
    return table.select("doc_id", "text", "edited", spotsigs.fingerprint(F.col("sigs")).alias("f"), spotsigs.fingerprint(F.col("edited_sigs")).alias("g"), spotsigs.jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near"), spotsigs.jaccard(F.col("sigs"), F.col("next_sigs")).alias("next")).collect()


def test_edited_texts(odd, none):
    order = sorted(((i, t or "") for i, t in ODD), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        want.append((i or 0, t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]))
    rows = found(odd)
    assert sorted((r.doc_id or 0, r.edited) for r in rows) == sorted(want)
    by_text = {}
    for r in rows:
        assert 0 <= r.near <= 1 and 0 <= r.next <= 1
        assert (r.f == r.g) == (r.near == 1)
        assert by_text.setdefault(r.text, r.f) == r.f
    assert found(none) == []


def test_ranges_agree_with_one_order(make, monkeypatch):
    rows = [(i * i, f"the text number {i} of the set is with some words " * (1 + i % 5)) for i in range(60)]
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 7)
    order = sorted(rows, reverse=True)
    want = {i: t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3] for k, (i, t) in enumerate(order)}
    assert {r.doc_id: r.edited for r in found(make(rows))} == want


def test_one_row_is_its_own_successor(make):
    assert [r.edited for r in found(make([(5, "abcdef")]))] == ["abcdab"]


def test_signatures_by_hand(spark):
    one = spark.range(1).select(spotsigs.signatures(F.lit("The cat sat. Of the, dog ran")), F.xxhash64(F.lit("the\x01cat"), F.lit("sat")), F.xxhash64(F.lit("of\x01the\x01dog"), F.lit("ran"))).first()
    assert sorted(one[0]) == sorted(one[1:])


def test_near_duplicates_by_brute_force(make):
    texts = [(i, " ".join(f"the w{(i // 3) * 100 + k} x{k}" for k in range(30)) + (f" the extra{i} tail{i}" if i % 3 else "")) for i in range(12)] + [(90, None)]
    docs = make(texts)
    sets = {r.doc_id: set(r.s) for r in docs.select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.near_duplicates(docs).collect()} == want and want


@pytest.mark.parametrize(("least", "n", "m", "shared"), [(0.55, 55, 100, 55), (0.8, 80, 100, 80), (0.1, 100, 1000, 100), (0.7, 70, 100, 70), (1.0, 9, 9, 9)])
def test_no_link_is_lost_at_the_threshold(make, least, n, m, shared):
    """Two sets whose likeness is the threshold itself."""
    words = [letters(i) for i in range(m + 1)]
    text = lambda k: " ".join(f"the {w} x" for w in words[:k])
    docs = make([(1, text(n)), (2, text(m) + (" tail" if n == m else "")), (3, "the other text here")])
    sizes = {r.doc_id: r.n for r in docs.select("doc_id", F.size(spotsigs.signatures(F.col("text"))).alias("n")).collect()}
    assert (sizes[1], sizes[2]) == (n, m)
    found = [(r.a, r.b, r.likeness) for r in spotsigs.near_duplicates(docs, least).collect()]
    assert found == ([(1, 2, pytest.approx(least))] if n < m else [])


def test_partners_are_in_neighbouring_partitions():
    for num, den in ((4, 5), (1, 10), (99, 100), (11, 20), (1, 1)):
        lows = spotsigs._sizes(num, den)
        part = lambda n: sum(low <= n for low in lows)  # noqa: B023, E731
        for n in (1, 2, 3, 9, 10, 11, 99, 100, 101, 1000, 4097, 1_000_000):
            assert part(n) - part(-(-n * num // den)) <= 1


def test_likenesses_by_brute_force(make):
    """Signatures, edited texts and both likenesses, worked out word by word."""
    rng = random.Random(3)
    words = ["the", "of", "und", "der", "la", "is", *(letters(i) for i in range(25))]
    rows = [(i, None if i == 7 else " ".join(rng.choices(words, k=rng.choice((0, 1, 5, 40, 90))))) for i in range(40)] + [(50, "The cat, of the dog ran away"), (49, "the cat of the dog ran off")]

    def spots(text):
        tokens = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if w]
        merged, run = [], []
        for i, w in enumerate(tokens):
            if w in spotsigs.ANCHORS and i + 1 < len(tokens):
                run.append(w)
            else:
                merged.append((tuple(run), w))
                run = []
        found = {(a, w, y[1]) for (a, w), y in zip(merged, merged[1:]) if a and w not in spotsigs.ANCHORS}  # noqa: B905
        return found or {text}

    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        follows = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + follows[: len(t) // 3]
        ratio = lambda a, b: len(a & b) / len(a | b)
        want[i] = (ratio(spots(t), spots(edited)), ratio(spots(t), spots(follows)))
    got = {}
    for r in spotsigs.compare_edited(make(rows)).select("doc_id", spotsigs.jaccard(F.col("sigs"), F.col("edited_sigs")).alias("a"), spotsigs.jaccard(F.col("sigs"), F.col("next_sigs")).alias("b")).collect():
        got[r.doc_id] = (r.a, r.b)
    assert {i: pytest.approx(x) for i, x in want.items()} == got and len({x for x in want.values()}) > 10


def test_digest_is_of_utf8(make):
    row = spotsigs.compare_edited(make([(1, "wörter ünd"), (2, "☃☃☃")])).select("doc_id", "edited", F.sha2("edited", 256).alias("h")).collect()
    assert all(r.h == hashlib.sha256(r.edited.encode()).hexdigest() for r in row)
