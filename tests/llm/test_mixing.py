from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from lakemart.llm.mixing import mix, mixed_rows, pivotal


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling by repeated sharing, in plain Python."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return out


def check(rows, got):
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        longest[source] = max(longest[source], n)
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6


def make(n, seed=1):
    rng = random.Random(seed)
    sources = ["hot"] * 8 + ["a", "b", "c", "Z", "é", None, ""]
    return [(i, rng.choice([None, "", " \t", "w " * rng.randrange(1, 60)]) if rng.random() < 0.2 else "w\x0b" * rng.randrange(1, 80), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("chunk,fan", [(50_000, 1000), (7, 3)])
def test_sources_come_near_their_targets(docs, chunk, fan):
    rows = make(400)
    df = mix(docs(rows), chunk_rows=chunk, fan_in=fan)
    source = {i: s for i, _, s in rows}
    out = [dict(r.asDict(), source=source[r["doc_id"]]) for r in df.collect()]
    assert len(out) == len(rows)
    check(rows, out)
    again = mix(docs(rows[::-1]), chunk_rows=chunk, fan_in=fan)
    assert sorted((r["doc_id"], r["copies"]) for r in again.collect()) == sorted((r["doc_id"], r["copies"]) for r in out)


def test_weights_go_by_code_point_and_null_is_last(docs):
    rows = [(1, "x " * 100, "b"), (2, "x " * 100, "B"), (3, "x " * 100, None)]
    got = {r["doc_id"]: r["target"] for r in mix(docs(rows)).collect()}
    want = targets({"b": 100, "B": 100, None: 100})
    assert got == pytest.approx({2: want["B"], 1: want["b"], 3: want[None]})


def test_pivotal_keeps_the_words_and_the_expectation():
    rng = random.Random(3)
    sizes, shares = [5, 9, 2, 30, 7], [0.3, 0.5, 0.9, 0.25, 0.6]
    mean = [0.0] * 5
    for _ in range(20_000):
        out, held, p = pivotal(sizes, shares, rng)
        value = [p if i == held else o for i, o in enumerate(out)]
        assert sum(s * v for s, v in zip(sizes, value)) == pytest.approx(sum(s * v for s, v in zip(sizes, shares)))
        mean = [m + v / 20_000 for m, v in zip(mean, value)]
    assert mean == pytest.approx(shares, abs=0.02)


def test_empty_and_repeated_rows(docs):
    assert mix(docs([])).count() == 0
    rows = [(7, "same text here", "a")] * 6 + [(7, "other", "b"), (None, "x y", "a"), (None, None, None)]
    got = mix(docs(rows)).collect()
    assert len(got) == len(rows)
    nothing = mix(docs([(1, None, "a"), (2, " ", "b")])).collect()
    assert [r["taken"] for r in nothing] == [0, 0]


def test_mixed_rows_keep_columns(docs):
    df = docs([(i, "w " * (i % 9), "a" if i % 3 else "b") for i in range(60)])
    out = mixed_rows(df)
    assert out.columns == df.columns + ["copies"]
    assert out.where("copies < 1").count() == 0
