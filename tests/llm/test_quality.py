from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from lakemart.llm import quality
from lakemart.llm.quality import Discriminant, accepted_rows, quality_scores, statistics

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = quality_scores(docs, labels)
    rows = got.where("held_out").join(labels, "doc_id").collect()
    auc = ranks(np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows]))
    assert auc > 0.97
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    assert np.mean(good) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    for r in rows[:50]:
        assert zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0


def ranks(score, label):
    order = score.argsort(kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_statistics_by_hand():
    x = statistics(pa.array(["", "A a", "x | y\nx | y", "wow!! wow!!", None, "é " * 5, " "]))
    assert np.isfinite(x).all()
    assert x[1][0] == np.log1p(2) and x[1][1] == 1
    assert x[2][NAMES("bars")] > x[1][NAMES("bars")]
    assert x[3][NAMES("same_as_before")] > x[1][NAMES("same_as_before")]
    assert x[2][NAMES("same_line")] > x[1][NAMES("same_line")]
    assert (x[0] == x[4]).all()


def NAMES(name):
    from lakemart.llm import quality

    return quality.NAMES.index(name)


def test_density_difference_matches_the_formula():
    rng = np.random.default_rng(1)
    parts = {0: rng.normal(0, 1, (300, 3)), 1: rng.normal(1, 2, (500, 3))}
    model = Discriminant({c: (len(x), x.sum(0), x.T @ x) for c, x in parts.items()}, pooled=0, round_shape=0)
    x = rng.normal(0, 2, (20, 3))
    log = {}
    for c, p in parts.items():
        cov = np.cov(p.T, bias=True)
        d = x - p.mean(0)
        log[c] = np.log(len(p)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(1)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-8)


def test_odd_tables(spark, docs):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0), (2, 0, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(1, "good text here"), (2, "bad | bad | bad"), (2, "bad | bad | bad"), (3, None), (None, ""), (4, "long " * 50_000)]
    got = quality_scores(docs(rows), labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality_scores(docs([]), labels).count() == 0
    none = quality_scores(docs(rows), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {1.0}


def test_accepted_rows_follow_the_scores(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    want = {r["doc_id"] for r in quality_scores(docs, labels).where("predicted = 1").collect()}
    kept = accepted_rows(docs, labels)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want


def test_a_task_of_the_fit_keeps_one_python_worker(spark, docs, monkeypatch):
    met = []

    def fit(statistics_of, labels):
        met.append(statistics_of._jdf.queryExecution().executedPlan().toString())
        return Discriminant({})

    monkeypatch.setattr(quality, "fit", fit)
    accepted_rows(docs([(1, "a b"), (2, None)]), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert len(met) == 1 and "MapInArrow" not in met[0]
