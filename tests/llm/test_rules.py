from __future__ import annotations

import random
import re
from collections import Counter

import oracle
import pytest
from plans_util import physical_plan
from pyspark.sql import functions as F

from lakemart.llm import rules

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def statistics(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if words_of(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_capitals": sum("A" <= c <= "Z" for c in text),
    }


def bucket(x):
    shift = max(x.bit_length() - 6, 0)
    return (x >> shift) + 32 * shift


def least(b):
    return b if b < 64 else (b - 32 * (b // 32 - 1)) << (b // 32 - 1)


def brute_force(rows, least_rows, reach=3):
    """(id, statistics, base_failed, kept) of (id, text, lang, source) rows."""
    measures = [("word_chars", "n_words"), ("n_symbols", "word_chars"), ("n_capitals", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words")]
    spreads, lows = [500, 10, 20, 100, 70], [True, False, False, False, False]
    judged = []
    for key, text, lang, source in rows:
        s = statistics(text)
        failed = s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]
        judged.append((key, lang, source, s, failed, [1000 * s[a] // s[b] if s[b] else 0 for a, b in measures]))
    out = []
    for key, lang, source, s, failed, values in judged:
        fine = not failed
        for group in (lambda r: r[1:3] == (lang, source), lambda r: r[1] == lang, lambda r: True):
            members = [r for r in judged if group(r) and not r[4]]
            if len(members) >= least_rows or group(("", "x", "y")):
                break
        for k, value in enumerate(values):
            ordered = sorted(bucket(r[5][k]) for r in members)
            if ordered:
                q1, q3 = (least(ordered[(q * len(ordered) + 3) // 4 - 1]) for q in (1, 3))
                spread = max(q3 - q1, spreads[k])
                fine = fine and value <= q3 + reach * spread and not (lows[k] and value < q1 - reach * spread)
        out.append((key, *s.values(), failed, fine))
    return out


def report(df, **settings):
    rows = rules.rule_report(df, **settings).drop("failed_rules").collect()
    return sorted(map(tuple, rows), key=str)


def test_query_equals_its_sql(spark):
    con = oracle.connect(FOLDER)
    df = rules.rule_report(spark.read.parquet(f"{FOLDER}/documents.parquet")).drop("failed_rules")
    assert oracle.differences(df, con, rules.report_sql()) is None


@pytest.mark.parametrize("least_rows", [1, 5, 40, 10_000])
def test_against_brute_force(spark, documents, least_rows):
    given = [(d[0], d[1], d[2], d[3]) for d in documents]
    given += [(1000, None, None, None), (1000, None, None, None), (1001, "", "en", None), (None, " \t\n\x0b\x0c\r ", "en", "src0")]
    given += [(1002, "wörter ünd 日本語 " * 30, None, "src1"), (1003, "# " * 9000 + "end", "en", "src0"), given[3], given[3]]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string")
    assert report(df, least_rows=least_rows) == sorted(brute_force(given, least_rows), key=str)


def test_windows_and_lines(spark):
    chance = random.Random(5)
    texts = ["a b c d e f g h " * 2, "a " * 50, "a b c d e f g h", "a b c d e f g", "l one\nl one\r\nl one\n\n\nl two\nl two"]
    texts += [" ".join(chance.choice("ab") for _ in range(n)) for n in (9, 20, 60, 300) for _ in range(5)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(rules.text_statistics(F.col("text")).alias("s"), "text")
    for row in df.collect():
        assert row["s"].asDict() == statistics(row["text"]), row["text"]


def test_buckets(spark):
    values = [*range(200), *(2**k + d for k in range(7, 50) for d in (-1, 0, 1))]
    df = spark.createDataFrame([(v,) for v in values], "x long").select("x", rules.bucket(F.col("x")).alias("b"))
    df = df.withColumn("least", rules.least_in_bucket(F.col("b")))
    for row in df.collect():
        assert row["b"] == bucket(row["x"]) and row["least"] == least(row["b"])
        assert row["least"] <= row["x"] <= row["least"] + row["least"] // 32


def test_sketches_merge_by_adding(spark, documents):
    docs = spark.createDataFrame([d[:4] for d in documents], "doc_id long, text string, lang string, source string")
    rows = rules._measured(docs, "text", "lang", "source", F.col("doc_id"))
    parts = [rules.quantile_sketches(rows.where(F.col("row") % 3 == k)) for k in range(3)]
    added = parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "source", "rule", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, added.collect())) == sorted(map(str, rules.quantile_sketches(rows).collect()))


def test_filtered_rows_keep_their_columns(spark, docs):
    texts = [f"{' '.join(f'word{i}{k}' for k in range(40))}" for i in range(30)]
    rows = [*enumerate(texts), (30, "$$$ ### " * 20 + texts[0]), (31, None), (31, None), (32, "short")]
    df = docs(rows)
    for name in ("row", "stats", "lang_", "fences", "kept", "base_failed", "n_words", "level", "rule", "bucket", "n"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    df = df.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    out = rules.rows_within_rules(df, least_rows=10)
    assert out.columns == df.columns and out.schema == df.schema
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(30))
    assert {r["stats"] for r in got} == {"own stats"} and got[0]["m"] == {"a": 1}


def test_empty_tables(spark, docs):
    assert rules.rule_report(docs([]).limit(0)).count() == 0
    assert rules.rows_within_rules(docs([]).limit(0)).count() == 0
    only_short = rules.rule_report(docs([(1, "a"), (2, None)])).collect()
    assert [r["kept"] for r in only_short] == [False, False]


def test_no_python_in_plan(spark):
    df = rules.rule_report(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    plan = physical_plan(df)
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_hot_group_is_counted_before_the_shuffle(spark):
    rows = spark.range(1, 20_001).selectExpr("'en' AS lang", "'hot' AS source", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', id * i))) AS text")
    measured = rows.select("lang", "source", rules.text_statistics(F.col("text")).alias("stats"))
    plan = physical_plan(rules.quantile_sketches(measured))
    assert "partial_count" in plan
    counts = rules.quantile_sketches(measured).groupBy("rule").agg(F.sum("n").alias("n")).collect()
    assert {r["n"] for r in counts} == {20_000}
