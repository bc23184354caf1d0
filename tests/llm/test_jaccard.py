from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lakemart.llm import jaccard, sets
from lakemart.llm.jaccard import bitmap, bits_for, near_duplicates, one_per_group, similar_pairs


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def expected(rows):
    found = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, len(found[i]), least.get(find(i)) if found[i] else k) for i, (k, _) in enumerate(rows)]


def check(docs, rows):
    got = near_duplicates(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(expected(rows), key=str)


def corpus(n, seed, edits=(0, 0, 1, 2, 3, 6)):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(500)] + ["The", "of", "é"] * 30
    passages = [[rng.choice(some) for _ in range(60)] for _ in range(3)]
    base = [[rng.choice(some) for _ in range(rng.randrange(1, 150))] for _ in range(n // 5)]
    out = []
    for i in range(n):
        text = list(rng.choice(base[: 1 + len(base) // 3])) if rng.random() < 0.6 else [rng.choice(some) for _ in range(rng.randrange(0, 150))]
        if rng.random() < 0.4:
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(passages)
        for _ in range(rng.choice(edits)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(some)
        joined = rng.choice([" ", "\n", " \t"]).join(text)
        out.append((i * 31 % 997, joined.upper() if rng.random() < 0.1 else joined))
    return out


ODD = [(990, None), (991, ""), (992, " \n"), (993, "a b c"), (994, "A  b\tC"), (None, "a b c"), (None, "q r s t u"), (None, "q r s t u"), (995, "a b"), (996, "x " * 3000), (5, "x " * 100), (5, "y z " * 50), (5, "y z " * 50), (998, "É b c d e"), (999, "é b c d e")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    check(docs, corpus(200, seed) + ODD)


def test_large_groups_are_cut(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 5)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard, "PACK_BYTES", 3000)
    monkeypatch.setattr(jaccard, "COMMON_SHARE", 0.0)
    monkeypatch.setattr(sets, "MOST_BYTES", 2000)
    check(docs, corpus(120, 3) + ODD)


def test_documents(docs, documents):
    check(docs, [(d[0], d[1]) for d in documents])


def test_pruned_pairs_are_not_similar():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 60, rng.integers(20, 400)).astype(np.uint64) for _ in range(20)]
    found = []
    for _ in range(150):
        x = base[rng.integers(20)].copy()
        x[rng.integers(0, len(x), rng.integers(0, len(x) // 5 + 1))] = rng.integers(0, 1 << 60)
        found.append(np.unique(x))
    found.sort(key=len)
    sizes = np.array([len(x) for x in found])
    maps = np.stack([bitmap(x, 256) for x in found])
    pairs = {(int(a), int(b)) for x, y in similar_pairs(sizes, maps, batch=64) for a, b in zip(x, y)}
    for i, a in enumerate(found):
        for j in range(i + 1, len(found)):
            common = len(np.intersect1d(a, found[j]))
            if 100 * common >= 75 * (len(a) + len(found[j]) - common):
                assert (i, j) in pairs
    assert len(pairs) < 150 * 149 / 4
    assert [bits_for(n) for n in (1, 256, 257, 4096, 90_000)] == [512, 512, 1024, 8192, 1 << 15]


def test_one_per_group(docs):
    rows = corpus(80, 6) + ODD
    want = expected(rows)
    df = docs(rows)
    kept = one_per_group(df)
    assert kept.schema == df.schema
    ids = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    heads = {}
    for (k, t), (_, n, c) in zip(rows, want):
        if n and c is not None and k == c:
            heads.setdefault(c, set()).add(t)
    rest = {(k, t) for (k, t), (_, n, c) in zip(rows, want) if not n or c is None}
    assert {x for x in ids if x in rest} == rest
    others = [x for x in ids if x not in rest]
    assert sorted(k for k, _ in others) == sorted(heads)
    assert all(t in heads[k] for k, t in others)
    assert len(ids) == len(set(ids))


def test_empty_table(docs):
    assert near_duplicates(docs([])).count() == 0
    assert one_per_group(docs([])).count() == 0
