from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakemart.llm import alignment as al
from lakemart.llm.common import importable

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spelled_a(token):
    visible = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    table = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    return bytes(table[c] for c in token)


def spelled_b(piece):
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def brute_force(texts, libraries):
    """Whole texts, all pairs of tokens, one byte range at a time."""
    model_a, model_b = libraries
    found, corpus = [], Counter()
    for text in texts:
        entry = None
        if text:
            ids_a, ids_b = model_a.encode(" " + text, add_special_tokens=False).ids, model_b.encode(text)
            bytes_a, bytes_b = [spelled_a(model_a.id_to_token(i)) for i in ids_a], [spelled_b(model_b.id_to_piece(i)) for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
                ends = [np.cumsum([len(t) for t in side]).tolist() for side in (bytes_a, bytes_b)]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups, links, i, j = [], [], 0, 0
                for cut in cuts:
                    p, q = i, j
                    while i < len(ids_a) and ends[0][i] <= cut:
                        i += 1
                    while j < len(ids_b) and ends[1][j] <= cut:
                        j += 1
                    groups.append((ids_a[p:i], ids_b[q:j]))
                    for x in range(p, i):
                        for y in range(q, j):
                            if ends[0][x] - len(bytes_a[x]) < ends[1][y] and ends[1][y] - len(bytes_b[y]) < ends[0][x]:
                                links.append((ids_a[x], ids_b[y]))
                entry = ids_a, ids_b, groups, links
                corpus.update(links)
        found.append(entry)
    highest = {}
    for (_, b), n in corpus.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for entry in found:
        if entry is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, groups, links = entry
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(corpus[p] == highest[p[1]] for p in links)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), best, sum(corpus[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = [
    None, None, "", " ", "  ", "a", "x   ", "\n\n\tb  c", "<s> a </s> <unk> <|endoftext|>", "日本語のテキスト ▁x ▁", "\x00a\x1f b", "é é ﬁ ½ ™",
    "\U0001f600\U0001f468‍\U0001f469 ok", "a\r\nb", "▁", " 　wide", "don't they'll I'm", "1234567890 3.14159", "ААААaaаа", "é" * 300, "﻿start",
]


def run(spark, texts, **settings):
    importable(spark)
    rows = [(k, t, "x", 1, 2, 3, "y") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, id long, pairs long, n long, best string")
    out = al.token_alignment(df, A, B, **settings)
    assert out.columns == ["doc_id", *COLUMNS]
    return [tuple(r)[1:] for r in out.orderBy("doc_id").collect()]


@pytest.mark.parametrize("most", [0, 500, al.FREQUENT_PAIRS])
def test_against_brute_force(spark, documents, libraries, most):
    texts = ODD + [d[1] for d in documents[:25]] + [documents[0][1]] * 3
    assert run(spark, texts, most_frequent=most) == brute_force(texts, libraries)


def test_random_texts(spark, libraries):
    chance = random.Random(1)
    signs = "aA bB  \n\t'.,-é日▁ #5"
    texts = ["".join(chance.choice(signs) for _ in range(chance.randint(1, 80))) for _ in range(300)]
    assert run(spark, texts) == brute_force(texts, libraries)


def test_long_texts_are_split_without_a_trace(spark, libraries, documents, monkeypatch):
    whole = "\n ".join(d[1] for d in documents[:25] if d[1])
    texts = [whole, "no_space" * 6000, "tab\t " * 9000 + "end of it"]
    assert run(spark, texts) == brute_force(texts, libraries)
    model_a, model_b = libraries
    for size in (1, 50, 1000):
        parts = list(al.parts_of(whole, size))
        assert " ".join(parts) == whole and len(parts) > 5
        assert [i for p in parts for i in model_a.encode(" " + p, add_special_tokens=False).ids] == model_a.encode(" " + whole, add_special_tokens=False).ids
        assert [i for p in parts for i in model_b.encode(p)] == model_b.encode(whole)


def test_texts_over_several_blocks(libraries, documents, monkeypatch):
    monkeypatch.setattr(al, "BLOCK_BYTES", 200)
    monkeypatch.setattr(al, "LONG_TEXT", 50)
    texts = [d[1] for d in documents[:8]]
    aligner = al.Aligner(A, B)
    monkeypatch.setattr(al.parts_of, "__defaults__", (50,))
    got = aligner.aligned(texts)
    for entry, expected in zip(got, brute_force(texts, libraries)):
        assert (entry.n_a, entry.n_b, entry.n_groups, entry.n_links) == expected[:4]
        assert entry.digest.hexdigest() == expected[6] and int(entry.counts[0].sum()) == expected[3]
        assert len(set(entry.pairs[0].tolist())) == len(entry.pairs[0])


@pytest.mark.parametrize("seed", range(20))
def test_shared_cuts(seed):
    chance = np.random.default_rng(seed)
    lengths = chance.integers(1, 400, 12)
    ends_a, ends_b, first, last, at = [], [], [], [], 0
    for n in lengths.tolist():
        a, b = (sorted(set(chance.choice(n, chance.integers(0, n), replace=False).tolist()) - {0} | {n}) for _ in range(2))
        first.append(len(ends_a))
        ends_a += [at + e for e in a]
        ends_b += [at + e for e in b]
        last.append(len(ends_a))
        at += n
    a, b = al.shared_cuts(np.array(ends_a), np.array(ends_b), np.array(first), np.array(last))
    edges = set(np.cumsum(lengths).tolist())
    assert [ends_a[k] for k in a] == [ends_b[k] for k in b] == sorted((set(ends_a) & set(ends_b)) - edges)


def test_long_interval_without_cuts_takes_few_steps(monkeypatch):
    steps = []
    search = np.searchsorted
    monkeypatch.setattr(al.np, "searchsorted", lambda *args, **kw: steps.append(1) or search(*args, **kw))
    n = 200_000
    a, b = al.shared_cuts(np.arange(2, 2 * n + 2, 2), np.append(np.arange(1, 2 * n, 2), 2 * n), np.array([0]), np.array([n]))
    assert not len(a) and not len(b) and len(steps) < 40


def test_broken_and_empty(spark, monkeypatch):
    aligner = al.Aligner(A, B)
    encode = aligner.b.encode
    monkeypatch.setattr(aligner.b, "encode", lambda texts: encode([t.replace("there", "theme") for t in texts]))
    given = ["hello there", "", "over there is more", "hello"]
    assert [(e.n_a, e.digest is None, len(e.pairs)) for e in aligner.aligned(given)] == [(0, True, 0)] * 3 + [(1, False, 1)]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert al.token_alignment(importable(spark) and df, A, B).count() == 0
    assert al.token_alignment(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect() == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_counts_are_added_before_the_shuffle(spark):
    from plans_util import physical_plan

    texts = spark.range(10).select(F.array(F.lit(7).cast("long")).alias("pairs"), F.array(F.lit(2)).alias("counts"))
    pairs = al.pair_counts(texts, 5)
    assert "partial_sum" in physical_plan(pairs)
    assert [tuple(r) for r in pairs.collect()] == [(7, 20, True)]
