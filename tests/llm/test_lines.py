from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakemart.llm import lines, sets
from lakemart.llm.common import Words, chunk_hashes, mix
from lakemart.llm.lines import _lines_at, _place_key, common_words, line_report, without_later_lines
from lakemart.llm.sets import FILTER_WORDS


def expected(rows):
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g) for (_, t), g in zip(rows, gone_lines(rows))]


def gone_lines(rows):
    parts = []
    for k, (i, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            words = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if len(words) >= 5:
                parts.append(((1 << 62 if i is None else i, n), k, words))
    gone = [set() for _ in rows]
    for at, k, words in parts:
        if any(o < at and 4 * len(words & w) >= 3 * len(words | w) for o, _, w in parts if 4 * min(len(w), len(words)) >= 3 * max(len(w), len(words))):
            gone[k].add(at[1])
    return gone


def check(docs, rows):
    df = docs(rows)
    want = expected(rows)
    out = without_later_lines(df)
    assert out.schema == df.schema
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str) == sorted(
        ((i, w, None if w is None else len(w)) for (i, _), w in zip(rows, want)), key=str
    )
    report = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in line_report(df).collect()), key=str)
    lines_of = [0 if t is None else len(t.split("\n")) for _, t in rows]
    removed = [len(g) for g in gone_lines(rows)]
    hashes = [hashlib.sha256((w or "").encode()).hexdigest() for w in want]
    assert report == sorted(zip([i for i, _ in rows], lines_of, removed, hashes), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "é"] * 40
    shared = [[rng.choice(words) for _ in range(rng.randrange(4, 40))] for _ in range(15)]
    out = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(0, 7)):
            line = list(rng.choice(shared)) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(0, 30))]
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if line:
                    line[rng.randrange(len(line))] = rng.choice(words)
            text.append(rng.choice([" ", "\t", "  "]).join(line))
        out.append((i * 17 % 503, "\n".join(text)))
    return out


ODD = [(900, None), (901, ""), (902, "\n\n"), (None, "a b c d e f"), (None, "a b c d e f"), (903, "a b c d e f\nf e d c b a\na b c d e"), (903, "a b c d e f\nf e d c b a\na b c d e"), (904, "p q r s\np q r s"), (905, "x " * 9000 + "\x0ba b c d e g\r\n1 2 3 4 5\n5 4 3 2 1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    check(docs, corpus(90, seed) + ODD)


@pytest.mark.parametrize("n", [20, 90])
def test_small_and_large_groups_agree(monkeypatch, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 60, 30).astype(np.uint64)
    tokens = []
    for _ in range(n):
        x = base.copy()
        x[rng.integers(0, 30, rng.integers(0, 9))] = rng.integers(0, 1 << 60)
        tokens.append(np.unique(x))
    sizes, places = np.array([len(t) for t in tokens]), [(k // 2, 0) for k in range(n)]
    monkeypatch.setattr(lines, "SMALL_GROUP", 0)
    large = lines.later_matches(sizes, tokens, places)
    monkeypatch.setattr(lines, "SMALL_GROUP", 1000)
    assert (lines.later_matches(sizes, tokens, places) == large).all() and 0 < large.sum() < n


def test_large_groups_are_cut_and_large_bins_passed_on(docs, monkeypatch):
    monkeypatch.setattr(lines, "GROUP_LINES", 4)
    monkeypatch.setattr(lines, "PACK_BYTES", 2000)
    monkeypatch.setattr(sets, "MOST_BYTES", 500)
    check(docs, corpus(60, 3) + ODD)


def test_documents(docs, documents):
    check(docs, [(d[0], d[1]) for d in documents])


def test_common_words_only_and_empty_table(docs):
    check(docs, [(i, " ".join(["a", "b", "c", "d", "e", "f", "g", "h"][: 5 + i % 4])) for i in range(40)])
    assert without_later_lines(docs([])).count() == 0
    assert line_report(docs([])).count() == 0


def test_chunk_hashes_tell_words_apart():
    words = ["a" * n for n in range(1, 140)] + [f"{'x' * n}{c}" for n in (0, 7, 8, 15, 16, 63, 64, 65, 200) for c in "\0bcé"]
    once, twice = chunk_hashes(Words(pa.array([" ".join(words)]))), chunk_hashes(Words(pa.array(["é " + "\n".join(words), "", None, "a"])))
    assert len(set(once.tolist())) == len(set(words))
    assert twice[1:-1].tolist() == once.tolist() and twice[-1] == once[0]
    assert len(chunk_hashes(Words(pa.array([None, "", " \n"])))) == 0


def test_lines_of_wanted_places():
    texts = [None, "", "one", "a\nb b\n\n", "\n", "é\nü x", "last"]
    rows = mix(np.arange(7, dtype=np.uint64) + np.uint64(1)).view(np.int64)
    places = [(r, k, line) for t, r in zip(texts, rows) for k, line in enumerate((t or "").split("\n"))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts), pa.array(rows)], ["id", "text", "row"])
    for taken in (batch, pa.Table.from_batches([batch.slice(0, 2), batch.slice(2)]).combine_chunks().to_batches()[0]):
        for some in (places, places[::2], places[1::3], []):
            bits = np.zeros(FILTER_WORDS, np.uint64)
            for row, k, _ in some:
                key = int(_place_key(np.int64(row), np.int64(k)))
                bits[(key >> 6) % FILTER_WORDS] |= np.uint64(1 << (key % 64))
            assert [x.decode() for x in _lines_at(taken, bits).to_pylist()] == [line for _, _, line in some]
    sliced = batch.slice(3, 3)
    assert [x.decode() for x in _lines_at(sliced, np.full(FILTER_WORDS, (1 << 64) - 1, np.uint64)).to_pylist()] == ["a", "b b", "", "", "", "", "é", "ü x"]


def test_place_keys_agree(spark):
    rows = [(-(1 << 63), 0), (5, 1), ((1 << 63) - 1, (1 << 31) - 1)]
    made = spark.createDataFrame(rows, "row long, line int").select(_place_key(F.col("row"), F.col("line").cast("long")).alias("key"))
    assert [r.key for r in made.collect()] == _place_key(np.array([r for r, _ in rows]), np.array([k for _, k in rows])).tolist()


def test_common_words_come_with_the_bytes_of_all_texts(docs):
    rows = [(1, "é a a b"), (2, None), (3, ""), (4, "a b\nc")]
    words, size = common_words(docs(rows).coalesce(1))  # a task sends no word that it meets once
    assert size == len("é a a b".encode()) + 5
    assert words.tolist() == chunk_hashes(Words(pa.array(["a b"]))).tolist()
    assert common_words(docs([]))[1] == 0


def test_places_of_a_class_are_settled_before_they_are_stored(docs, monkeypatch):
    stored, kinds = lines.stored, []

    def seen(df, name):
        out = stored(df, name)
        if name == "lines":
            kinds.extend((r["kind"], r["cls"], r["id"], r["line"]) for r in out.collect())
        return out

    monkeypatch.setattr(lines, "stored", seen)
    monkeypatch.setattr(lines, "PACK_BYTES", 40)  # a text or two in a batch
    same = "a b c d e f"
    check(docs, [(7, same), (5, same + "\nu v w x y"), (5, same + "\n1 2 3 4 5"), (9, same), (6, same), (8, same + " g")] + [(20 + i, same) for i in range(9)])
    first = [k for k in kinds if k[0] == lines.CLASS]
    assert len({k[1] for k in first}) == len(first) // 2 == 4  # check runs it twice
    assert sum(k[0] == lines.TIE for k in kinds) == 2 and {k[2:] for k in kinds if k[0] == lines.TIE} == {(5, 0)}
    assert sum(k[0] == lines.REPEAT for k in kinds) == 2 * 12


def test_lines_and_their_words_by_hand():
    texts = ["", "\n\na b a\n \nc", None, "\n", "b a", "\x0bd\r\nd e\n", "x" * 70]
    found = lines.Lines(pa.array(texts), lines.Rarity(np.zeros(0, np.uint64)), 1)
    assert list(zip(found.doc.tolist(), found.number.tolist(), found.size.tolist())) == [(1, 2, 2), (1, 4, 1), (4, 0, 2), (5, 0, 1), (5, 1, 2), (6, 0, 1)]
    assert found.cls[0] == found.cls[2] and len(set(found.cls.tolist())) == 5
    common = chunk_hashes(Words(pa.array(["a b c"])))
    common = np.concatenate((common, common[:1] + np.uint64(1), common[:1] + np.uint64(2)))  # with the same first bits
    order = lines.Rarity(common).of(np.concatenate((common, np.array([5, common[0] + np.uint64(3)], np.uint64))))
    assert (np.argsort(order[:5])[::-1] == np.arange(5)).all() and order[5] == 2 and order[6] == (common[0] + np.uint64(3)) >> np.uint64(1)


def test_places_are_folded_by_bin(monkeypatch):
    monkeypatch.setattr(lines, "MOST_PLACES", 3)
    places, found = lines._Places(), []
    rng = np.random.default_rng(5)
    cls, ids, rows, numbers = (rng.integers(0, n, 200) for n in (9, 4, 3, 3))
    for number in (-3, -1):
        for k in np.array_split(np.arange(200)[cls % 2 == number % 4 // 2], 40):
            if len(k):
                found.extend(places.add(number, lines._places(lines.CLASS, cls[k], ids[k], rows[k], numbers[k])))
                assert places.size <= max(3, 2 * 15)
    found.extend(places.close())
    kind, *columns = np.concatenate([np.stack(f) for f in found], axis=1)
    got = {k: sorted(zip(*(c[kind == k].tolist() for c in columns))) for k in (lines.CLASS, lines.TIE, lines.REPEAT)}
    every = sorted(set(zip(cls.tolist(), ids.tolist(), rows.tolist(), numbers.tolist())))
    first = {}
    for c, i, r, n in every:
        first[c] = min(first.get(c, (9, 9, 9)), (i, n, r))
    assert got[lines.CLASS] == sorted((c, i, r, n) for c, (i, n, r) in first.items())
    assert got[lines.TIE] == [x for x in every if (x[1], x[3]) == first[x[0]][:2] and x[2] != first[x[0]][2]]
    assert sorted(set(got[lines.REPEAT])) == [x for x in every if (x[1], x[3]) > first[x[0]][:2]]
