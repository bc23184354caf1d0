"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakemart.llm.common import importable
from lakemart.llm.rules import report_sql


@dataclass(frozen=True)
class LlmQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{folder}/{name}.parquet")


def decontamination(spark, folder):
    from lakemart.llm.decontaminate import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), least_words=1)


def near_copies(spark, folder):
    from lakemart.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, folder, "documents")).drop("row")


def mixing(spark, folder):
    from lakemart.llm.mixing import mix

    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def vectors(spark, folder):
    from lakemart.llm.vectors import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


def quality(spark, folder):
    from lakemart.llm.quality import quality_scores

    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def repeats(spark, folder):
    from lakemart.llm.repeats import without_repeats

    return without_repeats(table(spark, folder, "documents")).drop("kept")


def line_matches(spark, folder):
    from lakemart.llm.lines import line_report

    return line_report(table(spark, folder, "documents"), least_words=1)


def archives(spark, folder):
    from lakemart.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, folder, "pages"))


def token_lengths(spark, folder):
    import public_tokenizers

    from lakemart.llm.tokens import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def personal_data(spark, folder):
    from lakemart.llm.pii import personal_data_report

    return personal_data_report(table(spark, folder, "documents"))


def alignment(spark, folder):
    import public_tokenizers

    from lakemart.llm.alignment import token_alignment

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment(table(spark, folder, "documents"), *paths)


def quality_rules(spark, folder):
    from lakemart.llm.rules import rule_report

    return rule_report(table(spark, folder, "documents")).drop("failed_rules")


def whitened(spark, folder):
    from lakemart.llm.whitening import whitened_vectors

    return whitened_vectors(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_pigeonhole_edits": LlmQuery(decontamination),
    "op2_signature_trees": LlmQuery(near_copies),
    "op3_pivotal_mix": LlmQuery(mixing),
    "op4_metric_range_join": LlmQuery(vectors),
    "op5_quadratic_quality": LlmQuery(quality),
    "op6_super_kmers": LlmQuery(repeats),
    "op7_capture_index": LlmQuery(archives),
    "op8_line_join": LlmQuery(line_matches),
    "op9_token_lengths": LlmQuery(token_lengths),
    "op10_personal_data": LlmQuery(personal_data),
    "op11_shared_cuts": LlmQuery(alignment),
    "op12_adaptive_rules": LlmQuery(quality_rules, report_sql()),
    "op13_exact_whitening": LlmQuery(whitened),
}
