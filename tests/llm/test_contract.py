"""Registered queries of the subpackage, and the pipeline's contract."""

from __future__ import annotations

import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(n for n in contract.queries() if n.startswith("op")))
def test_query_gives_every_row(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    table = {"op4": "embeddings", "op7": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    key = {"embeddings": "vec_id", "pages": "page_id"}.get(table, "doc_id")
    rows = df.collect()
    if not name.startswith("op1_"):
        given = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()
        times = 16 if name.startswith("op13_") else 1
        assert sorted(r[key] for r in rows) == sorted(times * [r[0] for r in given])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    begun = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, docs, FOLDER)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = corpus_pipeline.stored(out, "stage")
        assert docs.count() <= begun
    assert docs.where("copies < 1").count() == 0
    again = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_pipeline_on_odd_documents(spark, docs, tmp_path):
    rows = [(1, None), (1, None), (2, ""), (None, "a b c d e f g h"), (3, "x " * 30_000), (4, "a b c d e f g h"), (5, "one two three four five six seven")]
    for name, frame in (
        ("documents", docs(rows)),
        ("labels", spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")),
    ):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 5 not in {r["doc_id"] for r in out}
    assert {r["doc_id"] for r in out} <= {None, 1, 2, 3, 4}


CLASHES = ["_id", "_row", "_i", "_r", "_lines", "_key", "_goes", "_first", "_order", "_source", "_number", "_place", "row", "run", "cls", "component"]


def test_stages_keep_columns_that_are_named_like_inner_ones(spark, docs):
    rows = [(k, f"line {k} of its own\nthis line is the same in all of them\n" + " ".join(f"w{k}{i}" for i in range(9)), f"s{k % 3}") for k in range(12)]
    rows += [rows[0], rows[0], (20, rows[1][1], "s0"), (None, None, None), (21, "", "s1")]
    df = docs(rows)
    for name in CLASHES:
        df = df.withColumn(name, F.lit(f"own {name}"))
    df = df.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    lines = corpus_pipeline.without_later_lines(df, least_words=1)
    assert lines.schema.names == df.schema.names and lines.count() == df.count()
    kept = corpus_pipeline.one_per_group(df)
    assert kept.schema.names == df.schema.names
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*range(12), 21, None], key=str)
    mixed = corpus_pipeline.mixed_rows(df.withColumn("copies", F.lit("own")))
    assert mixed.columns == [*df.columns, "copies"]
    for frame in (lines, kept, mixed):
        for r in frame.collect():
            assert all(r[name] == f"own {name}" for name in CLASHES) and r["m"] == {"k": 1}


def test_mixed_rows_are_the_rows_of_the_mix(spark, docs):
    from lakemart.llm.mixing import mix, mixed_rows

    text = "one two three four five six"
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "b"), *[(2, text, "c")] * 5, (None, text, None), (3, None, "a"), *[(k, text + f" {k}", "c") for k in range(10, 60)]]
    df = docs(rows)
    taken = sorted((r["doc_id"], r["copies"]) for r in mix(df).collect() if r["copies"] > 0 and r["doc_id"] is not None)
    assert sorted((r["doc_id"], r["copies"]) for r in mixed_rows(df).collect() if r["doc_id"] is not None) == taken
