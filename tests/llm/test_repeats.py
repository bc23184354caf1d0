from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from lakemart.llm import repeats
from lakemart.llm.repeats import without_repeats


def expected(rows, window):
    places = defaultdict(list)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    last = 1 << 62
    for (i, _), words in zip(rows, split):
        for p in range(len(words) - window + 1):
            places[tuple(words[p : p + window])].append((last if i is None else i, p))
    first = {w: min(x) for w, x in places.items()}
    out = []
    for (i, _), words in zip(rows, split):
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < (last if i is None else i, p):
                gone[p : p + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def check(docs, rows, window=20):
    got = without_repeats(docs(rows), window).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in got), key=str) == expected(rows, window)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "the", "of"] * 20
    passages = [[rng.choice(words) for _ in range(rng.randrange(15, 70))] for _ in range(8)]
    out = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.1:
            text += ["x"] * rng.randrange(1, 400)
        out.append((i * 37 % 1009, rng.choice([" ", "\n", "\t ", "  "]).join(text)))
        if rng.random() < 0.2:
            out.append((i * 37 % 1009 + 2000, out[-1][1]))
    return out


ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (None, "p " * 25 + "q"), (None, "p " * 25), (5, "\x0bz\x0c" * 50), (5, "k " + "z " * 30), (6, "m n " * 40), (6, "m n " * 40), (7, "\x00 \x00a " * 20), (8, "\xa0 " * 30)]


@pytest.mark.parametrize("window", [20, 5])
def test_equals_brute_force(docs, window):
    check(docs, corpus(120, window) + ODD, window)


def test_split_buckets(docs, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_TIMES", 0)
    monkeypatch.setattr(repeats, "PACK_BYTES", 3000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 3000)
    rows = corpus(150, 9) + ODD
    got = without_repeats(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in got), key=str) == expected(rows, 20)


def test_bucket_over_memory_is_sorted_in_parts(docs, monkeypatch):
    monkeypatch.setattr(repeats, "PACK_BYTES", 2000)
    monkeypatch.setattr(repeats, "HOT_TIMES", 1e-4)
    rows = corpus(100, 4) + ODD
    check(docs, rows)


def test_documents(docs, documents):
    check(docs, [(d[0], d[1]) for d in documents])


def test_very_long_text_and_empty_table(docs):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(50)) for _ in range(60_000))
    check(docs, [(1, text), (2, text[1000:90_000]), (3, "x" * 500_000)])
    assert without_repeats(docs([])).count() == 0
