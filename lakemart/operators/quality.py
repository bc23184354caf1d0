"""Data checks. Each returns the offending rows or counts; an empty result is a pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.operators.ordered import with_group_size


def duplicate_keys(df: DataFrame, keys: list[str], place: Column, place_name: str = "place") -> DataFrame:
    """Every place of every key that occurs more than once: keys, times seen, place.

    One row per place instead of one list per key, so a key may repeat without limit.
    """
    listed = df.select(*keys, place.alias(place_name))
    return with_group_size(listed, keys, "n").where("n > 1").select(*keys, "n", place_name)


def pattern_violations(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose value does not match; a NULL does not match either."""
    return df.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def forbidden_tokens(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose whole text holds one of the words, in any letter case, as a word."""
    return df.where(F.col(column).rlike(word_pattern(words)))


def forbidden_words(df: DataFrame, keys: list[str], column: str, words: DataFrame, word: str) -> DataFrame:
    """``keys`` and ``word`` of every word of a table that a text holds, in any letter case, however long the table.

    The words of the texts are looked up in the table, so a text is scanned once and not once
    per word. Texts stay where they are: keys and different words are joined, by broadcast
    where Spark measures the table to be small. A word consists of letters, digits and
    underscores; entries with other characters are found by ``forbidden_tokens`` only. Words
    come in lower case. Rows with equal keys count as one, NULL keys too; NULL or empty texts
    hold no word.
    """
    table = words.select(F.lower(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    parts = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    held = df.select(*keys, F.explode(parts).alias("word"))
    return held.join(table, "word", "left_semi").select(*keys, "word").distinct()


def word_pattern(words: list[str]) -> str:
    """Any of the words between characters of no word, in every script."""
    edge = r"[^\p{L}\p{N}_]"
    return rf"(?i)(?:^|{edge})(?:{'|'.join(map(re.escape, words))})(?:$|{edge})"


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a value, NULL or '', per column; one pass for all columns."""
    counted = df.agg(
        *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns])
    return counted.select(F.inline(pairs))


def outside_allowed(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose value is not in a short fixed list; NULL is outside."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def unmapped_codes(df: DataFrame, column: str, mapping: DataFrame, name: str) -> DataFrame:
    """Distinct values that a mapping table does not know; letter case is ignored."""
    values = df.select(F.upper(column).alias("value")).distinct()
    known = mapping.select(F.upper(name).alias("value"))
    return values.join(known, "value", "left_anti")


def code_or_fallback(df: DataFrame, column: str, mapping: DataFrame, name: str, code: str) -> DataFrame:
    """Add ``code`` from the mapping, else the value in upper case without underscores.

    The mapping holds one row per name; whether it is broadcast is left to its
    measured size.
    """
    normal = F.upper(F.col(column))
    lookup = mapping.select(F.upper(name).alias("_name"), F.upper(code).alias("_code"))
    return (
        df.join(lookup, normal == F.col("_name"), "left")
        .withColumn("code", F.coalesce("_code", F.replace(normal, F.lit("_"), F.lit(""))))
        .drop("_name", "_code")
    )
