import random

import numpy as np
import xxhash
from samples import ODD

from vicinal.llm import shingles, simhash
from vicinal.llm.components import components


def slow(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [slow(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((-1 if d is None else d, f"{prints[i]:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def got(docs):
    found = simhash.near_duplicates(docs)
    return sorted((r.doc_id if r.doc_id is not None else -1, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found.collect())


def test_against_brute_force(make, odd, none):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=120)
        for k in range(rng.choice((1, 1, 4))):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((10 * i + k, " ".join(copy)))
    assert got(make(rows)) == brute(rows)
    assert got(odd) == brute(ODD)
    assert got(none) == []


def test_every_pair_shares_a_list_and_long_lists_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for k in (1, 2, 4, 5):
            x = b
            for bit in rng.choice(64, k, replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps |= {int(base[0]) ^ 1 << i ^ 1 << j for i in range(12) for j in range(i)}
    values = np.array(sorted(fps), dtype=np.uint64)
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    monkeypatch.setattr(simhash, "LIST_ROWS", 16)
    found = simhash.links(table)
    roots = {r.node: r.root for r in components(found).collect()}
    parent = {int(v): int(v) for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    signed = {int(u): int(s) for u, s in zip(values, values.view(np.int64), strict=True)}
    same = {}
    for u in parent:
        same.setdefault(find(u), set()).add(roots.get(signed[u], signed[u]))
    assert all(len(x) == 1 for x in same.values())
    assert len({next(iter(x)) for x in same.values()}) == len(same)


def test_one_of_each_group_stays(make):
    text = " ".join(f"w{i}" for i in range(200))
    docs = make([(3, text), (2, text), (9, "something else here altogether"), (2, text), (None, "x"), (None, "x")])
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(docs).collect()) == [0, 2, 9]


def test_edited_copies_beyond_the_bits_go(make, monkeypatch):
    """Brute force over sets of five-word shingles, where the groups are dealt out and where not."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(25):
        words = rng.choices(vocabulary, k=rng.choice((3, 40, 150, 400)))
        for k in range(4):
            copy = list(words)
            for _ in range(k * len(words) // 80):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((10 * i + k, " ".join(copy)))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for _, t in rows]
    prints = [slow(t) for _, t in rows]
    root, beyond = list(range(len(rows))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            near, bits = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]), (prints[i] ^ prints[j]).bit_count()
            beyond += near and bits > 4
            if near or bits <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted({rows[find(i)][0] for i in range(len(rows))})
    assert beyond > 10
    assert sorted(r.doc_id for r in simhash.keep_one(make(rows)).collect()) == want
    monkeypatch.setattr(shingles, "GROUP_SHINGLES", 200)
    assert sorted(r.doc_id for r in simhash.keep_one(make(rows)).collect()) == want


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {i: 0 for i in range(51)} | {100: 100, 101: 100}
