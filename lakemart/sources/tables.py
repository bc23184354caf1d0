"""Scans: parquet folders, catalog tables, views over another layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lower_case_names(df: DataFrame) -> DataFrame:
    """Names are case-insensitive in the models, so every scan hands out lower case."""
    return df.toDF(*[c.lower() for c in df.columns])


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return lower_case_names(spark.read.parquet(f"{folder}/{name}.parquet"))


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files as a source that answers ungrouped counts from file footers, row groups unread.

    For counts only: Spark also takes a maximum from footers of such frames, and fails where a row
    group holds nothing but NULLs. Filtered or grouped counts read rows as ever. Turns
    ``spark.sql.parquet.aggregatePushdown`` on in the session, which no other scan of this
    library looks at.
    """
    older = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(older, None)
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set(older, "")
    try:
        return lower_case_names(spark.read.parquet(path))
    finally:
        if before is None:
            spark.conf.unset(older)
        else:
            spark.conf.set(older, before)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return lower_case_names(spark.table(name))


def create_view(df: DataFrame, name: str) -> DataFrame:
    """Register a query over other layers under a name and return it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def store_view(spark: SparkSession, name: str, query: str) -> None:
    """Keep a query over other layers in the catalog; names come from ``layers.database``."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table, empty ones included; of frames from ``read_footers`` no row is read."""
    # a count from footers is a sum over files, NULL where there are none; Spark takes any count for not NULL, so coalesce would go
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.when(F.col("n") > 0, F.col("n")).otherwise(0).alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def preview(df: DataFrame, order_by: list, n: int = 100) -> DataFrame:
    """The first ``n`` rows of a total order: a top-n per task, then one merge of n rows."""
    return df.orderBy(*order_by).limit(n)
