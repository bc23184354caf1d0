"""The corpus pipeline: five stages over ``documents``, each an operator of ``lakemart.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemart.llm.common import importable, stored
from lakemart.llm.decontaminate import clean_rows
from lakemart.llm.jaccard import one_per_group
from lakemart.llm.lines import without_later_lines
from lakemart.llm.mixing import mixed_rows
from lakemart.llm.quality import accepted_rows
from lakemart.llm.queries import LlmQuery


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted_rows(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go from their documents."""
    return without_later_lines(docs, least_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return clean_rows(docs, _table(spark, sf_dir, "benchmark"), least_words=1)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often; sources come near their target weights."""
    return mixed_rows(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]
#: The stages fit models, follow links and draw random numbers, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = _table(importable(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERY = LlmQuery(run, ORACLE_SQL)
