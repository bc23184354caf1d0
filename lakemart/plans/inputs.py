"""Inputs the registered queries share, in Spark and in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.functions.clean import blank_if_null, first_present, zero_if_null
from lakemart.sources.layers import database
from lakemart.sources.storage import create_database
from lakemart.sources.tables import read_parquet
from lakemart.session import work_folder

FIRST_CUT = dt.datetime(2024, 1, 11)
SECOND_CUT = dt.datetime(2024, 1, 21)
NOON_CUT = dt.datetime(2024, 1, 11, 12)
ORDER_CUT = dt.datetime(2000, 1, 1)
CLOCK = dt.datetime(2024, 2, 1, 6, 30)


@dataclass(frozen=True)
class Query:
    """A Spark query and, where one exists, the same in SQL."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def before(df: DataFrame, column: str, moment: dt.datetime) -> DataFrame:
    return df.where(F.col(column) < F.lit(str(moment)).cast("timestamp_ntz"))


def since(df: DataFrame, column: str, moment: dt.datetime) -> DataFrame:
    return df.where(F.col(column) >= F.lit(str(moment)).cast("timestamp_ntz"))


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a change log: key user_id, time ts, content kind (with NULLs) and k."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read_parquet(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.nullif("event_type", F.lit("error")).alias("kind"),
        k.alias("k"),
        (k >= 50).alias("high"),
        "value",
    )


CHANGE_LOG_SQL = """e AS (
  SELECT event_id, ts, user_id, nullif(event_type, 'error') AS kind,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AS high, value
  FROM events)"""


def loaded_events(events: DataFrame) -> DataFrame:
    """Events as a transform model hands them out, with their load date."""
    return events.select(
        "event_id",
        "user_id",
        F.col("ts").alias("created_dt"),
        blank_if_null(F.nullif("event_type", F.lit("error"))).alias("kind"),
        "value",
        F.col("ts").cast("date").alias("load_dt"),
    )


LOADED_EVENTS_SQL = """SELECT event_id, user_id, ts AS created_dt,
  coalesce(nullif(event_type, 'error'), '') AS kind, value, CAST(ts AS DATE) AS load_dt
FROM events"""


def clean_orders(orders: DataFrame) -> DataFrame:
    """Renames, NULL replacement and a date, over orders with NULLs put in."""
    priority = F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))
    status = F.nullif("o_orderstatus", F.lit("P"))
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        zero_if_null(F.nullif("o_custkey", F.lit(0))).alias("customer_id"),
        blank_if_null(priority).alias("priority"),
        first_present(priority, status).alias("label"),
        "o_orderstatus",
        "o_totalprice",
        F.col("o_orderdate").cast("date").alias("order_dt"),
    )


CLEAN_ORDERS_SQL = """SELECT o_orderkey AS order_id, coalesce(nullif(o_custkey, 0), 0) AS customer_id,
  coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), '') AS priority,
  coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), nullif(o_orderstatus, 'P'), '') AS label,
  o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS order_dt
FROM orders"""


def new_database(spark: SparkSession, layer: str) -> str:
    """A database of its own for one query run, below the shared folder."""
    folder = work_folder(spark, layer)
    name = database("dev", layer, folder.rsplit("-", 1)[1][:12])
    create_database(spark, name, folder)
    return name
