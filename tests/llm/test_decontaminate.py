from __future__ import annotations

import random
import re

import pytest

from lakemart.llm import decontaminate
from lakemart.llm.decontaminate import best_match, clean_rows, contaminated

SCHEMA = "item_id long, text string, end_word string"


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def least_distance(item, text):
    """Semi-global edit distance by the full table: least value and the first place where it is reached."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (w != t))
    return min(row), row.index(min(row))


def expected(docs, items):
    out = set()
    for i, text in docs:
        for k, item in set(items):
            w = words(item)
            if len(w) >= 5:
                distance, end = least_distance(w, words(text))
                if distance <= int(0.2 * len(w) + 1e-9):
                    out.add((i, k, distance, end, len(w)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(60)] + ["é", "The", "of"]
    items = [(k, " ".join(rng.choice(some) for _ in range(rng.randrange(3, 40)))) for k in range(12)]
    docs = []
    for i in range(n):
        text = [rng.choice(some) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                place = rng.randrange(len(part)) if part else 0
                part[place : place + rng.choice([0, 1])] = rng.choice([[], ["new"], [rng.choice(some)]])
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((i, rng.choice([" ", "\n", ", ", "-"]).join(text).upper() if rng.random() < 0.2 else " ".join(text)))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, docs, seed):
    rows, items = corpus(seed)
    got = contaminated(docs(rows), spark.createDataFrame([(*i, "x") for i in items], SCHEMA))
    assert {tuple(r) for r in got.collect()} == expected(rows, items)


def test_blocks_give_the_same(spark, docs, monkeypatch):
    rows, items = corpus(7)
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (300, "item_id", "text"))
    benchmark = spark.createDataFrame([(*i, "x") for i in items], SCHEMA)
    want = expected(rows, items)
    assert {tuple(r) for r in contaminated(docs(rows), benchmark).collect()} == want
    kept = clean_rows(docs(rows), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, _ in rows} - {w[0] for w in want})
    assert kept.columns == docs(rows).columns


def test_distance_of_random_words():
    rng = random.Random(2)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 80))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 60))]
        masks = {}
        for i, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << i
        assert best_match(masks, len(item), text) == least_distance(item, text)


def test_odd_rows(spark, docs):
    item = "one two three four five six"
    rows = [(1, None), (2, ""), (None, "x " + item), (3, item), (3, item), (4, "ONE, two\nthree; four (five) six!"), (5, "one two three four six"), (6, "one two three"), (7, "a " * 100_000 + item), (8, (item + " ") * 3000)]
    benchmark = spark.createDataFrame([(1, item, ""), (1, item, ""), (2, None, ""), (3, "", ""), (4, "one two three", ""), (None, item, "")], SCHEMA)
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["distance"]) for r in contaminated(docs(rows), benchmark).collect())
    want = [(str(i), k, d) for i, d in ((None, 0), (3, 0), (3, 0), (4, 0), (5, 1), (7, 0), (8, 0)) for k in ("1", "None")]
    assert got == sorted(want)
    assert sorted(r["doc_id"] for r in clean_rows(docs(rows), benchmark).collect()) == [1, 2, 6]
    assert contaminated(docs([]), benchmark).count() == 0
    assert contaminated(docs(rows), benchmark.limit(0)).count() == 0
    assert clean_rows(docs(rows), benchmark.limit(0)).count() == len(rows)
