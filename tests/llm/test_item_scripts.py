"""Benchmark items of scripts without blanks and items of few words, in the query and the pipeline stage."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline
from lakemart.llm.decontaminate import word_hashes
from lakemart.llm.queries import QUERIES

ZH = "水在标准大气压下的沸点是多少摄氏度"
TH = "เมืองหลวงของประเทศไทยคืออะไร"
JA = "日本で一番高い山は何ですか"


def words(text):
    w = word_hashes(pa.array(["é", text, "x"]))
    return [w.data[a:b].tobytes().decode() for a, b in zip(w.begin[w.first[1] : w.first[2]], w.end[w.first[1] : w.first[2]])]


def test_words():
    assert words("ab水 沸c。d") == ["ab", "水", "沸", "c", "d"]
    assert words("水") == ["水"] and words("。") == [] and words("") == []
    assert words("«Über’s» — naïve…𠀀𠀁x ไทย") == ["Über", "s", "naïve", "𠀀", "𠀁", "x", "ไ", "ท", "ย"]
    assert words("हिन्दी می‌شود a b") == ["हिन्दी", "می‌شود", "a", "b"]


def test_query_and_stage(spark, docs, tmp_path):
    items = [(1, ZH + "？"), (2, TH), (3, JA), (4, "Who wrote Hamlet?"), (5, "？！"), (6, "π")]
    rows = [
        (1, f"前文。{ZH}，后文"), (2, f"ก{TH}ข"), (3, f"「{JA.replace('高', '低')}」と聞く"), (4, "so: WHO wrote\nHamlet"), (5, "who wrote the Hamlet"),
        (6, "who wrote hamlets"), (7, "水在标准气压？！"), (8, None), (9, "r²·π who wrote Hamlet, who wrote Hamlet"), (10, ""),
    ]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["item_id"], r["distance"], r["end_word"], r["item_words"]) for r in QUERIES["op1_pigeonhole_edits"].run(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 0, 2 + len(ZH), len(ZH)), (2, 2, 0, 1 + len(TH), len(TH)), (3, 3, 1, len(JA), len(JA)), (4, 4, 0, 4, 3), (9, 4, 0, 5, 3), (9, 6, 0, 2, 1)]
    kept = corpus_pipeline.decontamination(spark, docs(rows), str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in kept) == [5, 6, 7, 8, 10]
