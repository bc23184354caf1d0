"""Sinks: published tables that are never empty or half written.

Parquet tables know no MERGE, UPDATE or read-while-overwrite. A published name
is therefore a view over a versioned table: the new state is written in full as
the next version, then the view is switched, one step in the catalog. Readers
see the old state or the new one. No file is moved, which matters on object
stores, and a failed write leaves the name untouched.

A history table keeps its ended versions in a second table that is only added
to. A run rewrites the open slice and adds what ended, so its cost follows the
number of keys, not the length of the history.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakemart.sources.tables import read_footers

_VERSION = re.compile(r"__v(\d+)_[0-9a-f]{8}$")


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{at}")


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def _view_text(spark: SparkSession, table: str) -> str:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'View Text'").first()
    if described is None:
        raise ValueError(f"{table} was not published from here")
    return described["data_type"]


def current_version(spark: SparkSession, table: str) -> str | None:
    """The versioned table behind a published name."""
    if not exists(spark, table):
        return None
    return re.search(r"FROM\s+(\S+)", _view_text(spark, table)).group(1).replace("`", "")


def read_current(spark: SparkSession, table: str) -> DataFrame | None:
    """The published state, or None before the first run.

    The frame keeps to the version it was taken from, also after a switch.
    """
    return spark.table(table) if exists(spark, table) else None


def read_open(spark: SparkSession, table: str) -> DataFrame:
    """The open slice of a history table; nothing else is scanned."""
    return spark.table(current_version(spark, table)).where("_open").drop("_open")


def read_current_footers(spark: SparkSession, table: str) -> DataFrame:
    """The published state for counts (see ``read_footers``)."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {current_version(spark, table)}")
    return read_footers(spark, described.where("col_name = 'Location'").first()["data_type"])


def newest_partition(spark: SparkSession, table: str, column: str) -> dt.date | None:
    """The newest date of a table partitioned by it, from the catalog alone."""
    listed = spark.sql(f"SHOW PARTITIONS {current_version(spark, table)}")
    day = F.try_to_date(F.regexp_extract("partition", rf"(?:^|/){column}=(\d{{4}}-\d\d-\d\d)", 1))
    return listed.agg(F.max(day)).first()[0]


def publish(
    df: DataFrame, table: str, partition_by: tuple[str, ...] = (), keep: int = 1, number: int | None = None
) -> int:
    """Write the next version, switch the name to it, return the rows written.

    The state a plan reads stays in place until after the switch, so a plan may
    read the table it replaces. ``keep`` older versions stay for running readers.
    ``number`` sets the version's number instead of counting on.
    """
    spark = df.sparkSession
    number = _next_number(spark, table) if number is None else number
    new = _version_name(table, number)
    rows = _counted_write(df, lambda w: _partitioned(w, partition_by).mode("errorifexists").saveAsTable(new))
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {new}")
    _drop_old_versions(spark, table, number - keep)
    return rows


def publish_history(
    delta: DataFrame, table: str, is_open: Column, restart: bool = False, keep: int = 1
) -> int:
    """Publish the next state of a history table, return the rows written.

    ``delta`` holds the new open slice and the versions that ended in this run;
    versions that ended before are kept as they are, or dropped from the history
    with ``restart``. What a failed run has left behind is hidden by the view and
    overwritten by the next run.
    """
    spark = delta.sparkSession
    number = first = _next_number(spark, table)
    if number > 1 and not restart:
        first = int(re.search(r"BETWEEN (\d+) AND", _view_text(spark, table)).group(1))
    new, ended = _version_name(table, number), f"{table}__ended"
    marked = delta.withColumn("_open", F.coalesce(is_open, F.lit(False)))
    rows = _counted_write(marked, lambda w: _partitioned(w, ("_open",)).mode("errorifexists").saveAsTable(new))
    names = ", ".join(f"`{c}`" for c in delta.columns)
    ended_now = f"SELECT {names} FROM {new} WHERE NOT _open"
    if exists(spark, ended):
        spark.sql(f"INSERT OVERWRITE {ended} PARTITION (_version = {number}) {ended_now}")
    else:
        spark.sql(
            f"CREATE TABLE {ended} USING parquet PARTITIONED BY (_version) "
            f"AS SELECT *, {number} AS _version FROM ({ended_now})"
        )
    spark.sql(
        f"CREATE OR REPLACE VIEW {table} AS SELECT {names} FROM {new} WHERE _open "
        f"UNION ALL SELECT {names} FROM {ended} WHERE _version BETWEEN {first} AND {number}"
    )
    _drop_old_versions(spark, table, number - keep)
    return rows


def append(df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> int:
    """Add rows to a published table, creating it on the first run; rows written."""
    spark = df.sparkSession
    version = current_version(spark, table)
    if version is None:
        return publish(df, table, partition_by)
    stored = spark.table(version).schema
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in stored]:
        raise ValueError(f"schema of {table} differs from the rows to append")
    return _counted_write(df, lambda w: _partitioned(w, partition_by).mode("append").saveAsTable(version))


def _version_name(table: str, number: int) -> str:
    return f"{table}__v{number:06d}_{uuid.uuid4().hex[:8]}"


def _next_number(spark: SparkSession, table: str) -> int:
    old = current_version(spark, table)
    return int(_VERSION.search(old).group(1)) + 1 if old else 1


def _partitioned(writer, columns: tuple[str, ...]):
    writer = writer.format("parquet")
    return writer.partitionBy(*columns) if columns else writer


def _counted_write(df: DataFrame, write: Callable) -> int:
    """Count rows while they are written, not by a second scan."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")).write)
    return seen.get["rows"]


def versions(spark: SparkSession, table: str) -> dict[int, str]:
    """Number -> versioned table, for the versions that were written in full."""
    schema, _, name = table.rpartition(".")
    listed = spark.sql(f"SHOW TABLES{f' IN {schema}' if schema else ''} LIKE '{name}__v*'").collect()
    found = {}
    for row in listed:
        match = _VERSION.search(row["tableName"])
        if match and row["tableName"][: match.start()] == name.lower():
            found[int(match.group(1))] = f"{schema}.{row['tableName']}" if schema else row["tableName"]
    return found


def _drop_old_versions(spark: SparkSession, table: str, below: int) -> None:
    for number, version in versions(spark, table).items():
        if number < below:
            spark.sql(f"DROP TABLE IF EXISTS {version}")
