import random

import numpy as np
from samples import ODD

from vicinal.llm import decontaminate as d

ITEMS = [(i, " ".join(f"t{(i * 37 + k * k) % 211}x" for k in range(n))) for i, n in enumerate((5, 9, 16, 30, 47, 64, 90))]


def plain(a, b):
    """Least edit distance of a to a part of b, by the table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 80))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 60))]
        assert d.best_match(a, b)[0] == plain(a, b)


def test_recall_against_brute_force_and_no_false_finds():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 80)))) for i in range(120)]
    index, hits, due = d.ItemIndex(items), 0, 0
    for i, text in items:
        ws = text.split()
        for share in (0, 0.05, 0.1, 0.2):
            edited = list(ws)
            for _ in range(int(share * len(ws))):
                at, how = rng.randrange(len(edited)), rng.choice("sid")
                edited[at : at + (how != "i")] = [] if how == "d" else [rng.choice(words)]
            doc = rng.choices(words, k=100) + edited + rng.choices(words, k=60)
            ids = np.array([d.word_id(w) for w in doc], dtype=np.uint64)
            found = {x[1]: x[2] for x in index.search([ids])}
            least = plain(index.words[i], ids.tolist())
            if least <= d.edit_allowance(len(ws)):
                due += 1
                hits += i in found
            assert set(found) <= {i} and (i not in found or found[i] >= least)
    assert due > 400 and hits >= 0.95 * due


def test_every_size_is_found_at_the_full_edit_limit():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    number = {w: d.word_id(w) for w in words}
    for n in (5, 6, 7, 9, 10, 12, 14, 15, 18, 21, 22, 25, 32, 33, 48, 80, 120):
        items = [(i, " ".join(rng.choices(words, k=n))) for i in range(40)]
        texts = []
        for _, text in items:
            edited = text.split()
            for _ in range(d.edit_allowance(n)):
                at, how = rng.randrange(len(edited)), rng.choice("sid")
                edited[at : at + (how != "i")] = [] if how == "d" else [rng.choice(words)]
            around = [rng.choices(words, k=rng.choice((0, 40))) for _ in range(2)]
            texts.append(np.array([number[w] for w in around[0] + edited + around[1]], dtype=np.uint64))
        texts[0] = texts[0][:0]
        found = {(text, item) for text, item, *_ in d.ItemIndex(items).search(texts)}
        assert found == {(i, i) for i in range(1, 40)}, n


def leaks(docs, items, spark):
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id int, text string, doc_id string")
    return sorted((r.doc_id or 0, r.item_id, r.distance) for r in d.leaks(docs, bench).collect())


def test_leaks_of_odd_rows(spark, make, odd, none, monkeypatch):
    rows = [(20 + i, f"some words before {t.upper()} and after.") for i, t in ITEMS] + [(50, " ".join(t for _, t in ITEMS)), (51, "clean words " * 50)]
    want = [(20 + i, i, 0) for i, _ in ITEMS] + [(50, i, 0) for i, _ in ITEMS]
    items = [*ITEMS, (90, None), (91, ""), (92, "clean words"), (93, " -- ")]
    want = sorted([*want, (51, 92, 0)])
    assert leaks(make(rows + ODD), items, spark) == want
    monkeypatch.setattr(d, "BLOCK_BYTES", 100)
    monkeypatch.setattr(d, "TURN_BYTES", 3000)
    assert leaks(make(rows + ODD), items, spark) == want
    assert leaks(none, items, spark) == [] and leaks(odd, [], spark) == []
    bench = spark.createDataFrame(items[:-2], "item_id int, text string")
    assert sorted((r.doc_id or 0) for r in d.keep_clean(make(rows + ODD), bench).collect()) == sorted([*((i or 0) for i, _ in ODD), 51])


def test_short_items_are_found_verbatim(spark, make):
    """Items of one to four words, by looking through every text; words that share a hash's low bits or parts are none."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=1 + i % 4))) for i in range(60)] + [(70, "日本"), (71, "Alpha beta, gamma delta")]
    rows = [(i, ", ".join(rng.choices(words, k=rng.randint(0, 30))).upper()) for i in range(80)] + [(90, "x 日本 y"), (91, "alpha beta gamma delta"), (92, "alpha beta gamma"), (93, "日本語")]
    plain_words = {i: "".join(c if c.isalnum() else " " for c in t.lower()).split() for i, t in [*rows, *((1000 + i, t) for i, t in items)]}
    want = []
    for i, _ in rows:
        for j, _ in items:
            item, text = plain_words[1000 + j], plain_words[i]
            if any(text[k : k + len(item)] == item for k in range(len(text))):
                want.append((i, j, 0))
    assert leaks(make(rows), items, spark) == sorted(want) and len(want) > 300


def test_blocks_of_items_take_one_scan(spark, make, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 200)
    docs, bench = make([(1, ITEMS[3][1])]), spark.createDataFrame([(i, t) for i, t in ITEMS] * 3, "item_id int, text string")
    assert len(list(d.item_blocks(bench, "item_id", "text", 200))) > 10
    for found in (d.leaks(docs, bench), d.keep_clean(docs, bench)):
        assert found._jdf.queryExecution().toString().split("Physical Plan")[1].count("MapInArrow") == 1


def test_equal_hashes_of_different_words_are_no_find():
    """Finds are confirmed by the words themselves."""
    item = " ".join(f"w{k}" for k in range(30))
    index, texts = d.ItemIndex([(1, item), (2, "one two")]), d.Numbered(["x " + item, "one two"])
    assert [x[:3] for x in index.search(texts.ids, texts.words)] == [(0, 0, 0), (1, 1, 0)]
    assert index.search(texts.ids, lambda text, low, high: [b"other"] * (high - low)) == []
