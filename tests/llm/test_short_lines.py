"""Lines of any non-empty word set: the query and the pipeline stage leave none out."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline
from lakemart.llm.queries import QUERIES
from lakemart.llm.sets import mapped_length


def gone_lines(rows):
    parts = []
    for k, (i, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            words = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if words:
                parts.append(((1 << 62 if i is None else i, n), k, words))
    gone = [set() for _ in rows]
    for at, k, words in parts:
        if any(o < at and 4 * len(words & w) >= 3 * len(words | w) for o, _, w in parts):
            gone[k].add(at[1])
    return gone


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["the", "of", "é"]
    lines = lambda: [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 6))]
    return [(i * 17 % 503, "\n".join(lines() + rng.choice([[], ["Home"], ["目录第一章没有空格的一行"], [""]]))) for i in range(n)]


ODD = [(900, None), (901, "\n\n"), (None, "Home"), (None, "a b c"), (902, "c b a\nb a\na b\na b c d"), (903, "Home\nHome\n \nmenu"), (903, "Home\nHome\n \nmenu")]


def test_query_and_stage_equal_brute_force(spark, docs, tmp_path):
    rows = corpus(80, 4) + ODD
    gone = gone_lines(rows)
    left = [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g) for (_, t), g in zip(rows, gone)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    report = QUERIES["op8_line_join"].run(spark, str(tmp_path)).collect()
    want = [(i, 0 if t is None else len(t.split("\n")), len(g), hashlib.sha256((x or "").encode()).hexdigest()) for (i, t), g, x in zip(rows, gone, left)]
    assert sorted(map(tuple, report), key=str) == sorted(want, key=str)
    out = corpus_pipeline.line_dedup(spark, docs(rows), str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(((i, x) for (i, _), x in zip(rows, left)), key=str)


def test_small_sets_are_mapped_whole():
    assert [int(mapped_length(n)) for n in (1, 3, 4, 8, 9, 30)] == [1, 3, 4, 8, 5, 15]
