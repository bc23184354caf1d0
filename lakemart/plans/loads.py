"""Queries: scans, sinks, projections, incremental loads, dedupe and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.operators.dedupe import distinct_rows, latest_per_key
from lakemart.operators.incremental import incremental_rows
from lakemart.operators.merge import append_all, merge_distinct, merge_latest
from lakemart.plans.inputs import (
    CHANGE_LOG_SQL,
    CLEAN_ORDERS_SQL,
    FIRST_CUT,
    LOADED_EVENTS_SQL,
    NOON_CUT,
    ORDER_CUT,
    SECOND_CUT,
    Query,
    before,
    change_log,
    clean_orders,
    loaded_events,
    new_database,
    since,
)
from lakemart.session import work_folder
from lakemart.sources.csvfiles import read_csv, write_csv
from lakemart.sources.storage import append, publish, read_current
from lakemart.sources.tables import create_view, preview, read_footers, read_parquet, row_counts
from lakemart.streaming.refresh import keep_newest, refresh

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def source_scan(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "customer")


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    part = read_parquet(spark, folder, "part")
    path = work_folder(spark, "csv")
    write_csv(part, path)
    return read_csv(spark, path, part.schema)


def full_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    table = f"{new_database(spark, 'transform')}.orders"
    orders = read_parquet(spark, folder, "orders").select("*")
    publish(orders, table)
    publish(orders, table)
    return read_current(spark, table)


def staged_swap(spark: SparkSession, folder: str) -> DataFrame:
    """The second state is computed from the very table it replaces."""
    table = f"{new_database(spark, 'consumption')}.dim_part"
    publish(read_parquet(spark, folder, "part"), table)
    current = read_current(spark, table)
    publish(current.withColumn("p_retailprice", F.col("p_retailprice") * 2), table)
    return spark.table(table)


def cross_layer_view(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation, region = (read_parquet(spark, folder, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return create_view(joined.select("c_custkey", "c_name", "n_name", "r_name"), "vw_customers")


def clean_project(spark: SparkSession, folder: str) -> DataFrame:
    return clean_orders(read_parquet(spark, folder, "orders"))


def first_run_load(spark: SparkSession, folder: str) -> DataFrame:
    events = read_parquet(spark, folder, "events")
    return loaded_events(incremental_rows(events, None, "ts", "load_dt"))


def watermark_day(spark: SparkSession, folder: str) -> DataFrame:
    events = read_parquet(spark, folder, "events")
    target = loaded_events(before(events, "ts", NOON_CUT))
    return loaded_events(incremental_rows(events, target, "ts", "load_dt"))


def watermark_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    events = read_parquet(spark, folder, "events")
    target = loaded_events(before(events, "ts", NOON_CUT))
    return loaded_events(incremental_rows(events, target, "ts", "created_dt", "timestamp"))


def incremental_append(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs: the first rows, then the rest, then nothing new."""
    table = f"{new_database(spark, 'transform')}.events"
    events = read_parquet(spark, folder, "events")
    for landed in (before(events, "ts", FIRST_CUT), events, events):
        rows = incremental_rows(landed, read_current(spark, table), "ts", "load_dt")
        append(loaded_events(rows), table)
    return spark.table(table)


def merge_no_key(spark: SparkSession, folder: str) -> DataFrame:
    events = read_parquet(spark, folder, "events")
    return append_all(before(events, "ts", SECOND_CUT), since(events, "ts", FIRST_CUT))


def distinct_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_rows(read_parquet(spark, folder, "lineitem").select("l_orderkey", "l_suppkey"))


def latest_order(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders")
    return latest_per_key(orders, "o_custkey", "o_orderdate", ("o_orderkey",))


def latest_ephemeral(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_orders(read_parquet(spark, folder, "orders"))
    return latest_per_key(cleaned, "customer_id", "order_dt", ("order_id",))


def latest_composite(spark: SparkSession, folder: str) -> DataFrame:
    log = change_log(spark, folder).select("user_id", "kind", "ts", "event_id", "value")
    return latest_per_key(log, ["user_id", "kind"], "ts", ("event_id",))


def _merged(log: DataFrame, keys: list[str], **options) -> DataFrame:
    target = latest_per_key(before(log, "ts", FIRST_CUT), keys, "ts", ("event_id",))
    return merge_latest(target, since(log, "ts", FIRST_CUT), keys, "ts", ("event_id",), **options)


def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    slot = F.concat_ws(":", "user_id", "k").alias("slot")
    log = change_log(spark, folder).select(slot, "event_id", "ts", "kind", "value")
    return _merged(log, ["slot"])


def merge_composite(spark: SparkSession, folder: str) -> DataFrame:
    items = read_parquet(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    pairs = ["l_partkey", "l_suppkey"]
    target = before(items, "l_shipdate", ORDER_CUT).select(*pairs, F.lit("old").alias("seen")).distinct()
    batch = since(items, "l_shipdate", ORDER_CUT).select(*pairs, F.lit("new").alias("seen"))
    return merge_distinct(target, batch, pairs)


def merge_partial_update(spark: SparkSession, folder: str) -> DataFrame:
    log = change_log(spark, folder).select("user_id", "k", "event_id", "ts", "kind", "value")
    return _merged(log, ["user_id", "k"], update_columns=["value", "kind"])


def merge_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    log = change_log(spark, folder).select("user_id", "kind", "event_id", "ts", "value")
    keys = ["user_id", "kind"]
    plain = _merged(log, keys).withColumn("null_safe", F.lit(False))
    return plain.unionByName(_merged(log, keys, null_safe_keys=True).withColumn("null_safe", F.lit(True)))


def table_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return row_counts({name: read_footers(spark, f"{folder}/{name}.parquet") for name in TABLES})


def preview_limit(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_parquet(spark, folder, "customer")
    return preview(customer, [F.col("c_acctbal").desc(), F.col("c_custkey")], 100)


def refresh_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events land as three files; each trigger merges one into the latest row per user."""
    events = read_parquet(spark, folder, "events")
    landing = work_folder(spark, "landing")
    events.repartition(3).write.parquet(landing)
    table = f"{new_database(spark, 'consumption')}.latest_event"
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    query = refresh(stream, table, keep_newest(["user_id"], "ts", ("event_id",)), work_folder(spark, "progress"), buckets=8)
    query.awaitTermination()
    return spark.table(table)


_SPLIT = f"""{CHANGE_LOG_SQL},
t AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-11'
      QUALIFY row_number() OVER (PARTITION BY {{keys}} ORDER BY ts DESC, event_id DESC) = 1),
s AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-11'
      QUALIFY row_number() OVER (PARTITION BY {{keys}} ORDER BY ts DESC, event_id DESC) = 1)"""

QUERIES = {
    "source_scan": Query(source_scan, "SELECT * FROM customer"),
    "csv_round_trip": Query(csv_round_trip, "SELECT * FROM part"),
    "full_rebuild": Query(full_rebuild, "SELECT * FROM orders"),
    "staged_swap": Query(
        staged_swap,
        "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice * 2 AS p_retailprice FROM part",
    ),
    "cross_layer_view": Query(
        cross_layer_view,
        """SELECT c_custkey, c_name, n_name, r_name FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "clean_project": Query(clean_project, CLEAN_ORDERS_SQL),
    "first_run_load": Query(first_run_load, LOADED_EVENTS_SQL),
    "watermark_day": Query(
        watermark_day,
        LOADED_EVENTS_SQL
        + """
WHERE CAST(ts AS DATE) > (SELECT coalesce(max(CAST(ts AS DATE)), DATE '2010-01-01')
                          FROM events WHERE ts < TIMESTAMP '2024-01-11 12:00:00')""",
    ),
    "watermark_timestamp": Query(
        watermark_timestamp,
        LOADED_EVENTS_SQL
        + """
WHERE ts > (SELECT coalesce(max(ts), TIMESTAMP '2010-01-01')
            FROM events WHERE ts < TIMESTAMP '2024-01-11 12:00:00')""",
    ),
    "incremental_append": Query(incremental_append, LOADED_EVENTS_SQL),
    "merge_no_key": Query(
        merge_no_key,
        """SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-21'
UNION ALL SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-11'""",
    ),
    "distinct_rows": Query(distinct_pairs, "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem"),
    "latest_per_key": Query(
        latest_order,
        """SELECT * FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    ),
    "latest_ephemeral": Query(
        latest_ephemeral,
        f"""SELECT * FROM ({CLEAN_ORDERS_SQL}) c
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY order_dt DESC, order_id DESC) = 1""",
    ),
    "latest_composite": Query(
        latest_composite,
        f"""WITH {CHANGE_LOG_SQL} SELECT user_id, kind, ts, event_id, value FROM e
QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, event_id DESC) = 1""",
    ),
    "merge_upsert": Query(
        merge_upsert,
        f"""WITH {_SPLIT.format(keys='user_id, k')},
u AS (SELECT * FROM s UNION ALL
      SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = t.user_id AND s.k = t.k))
SELECT concat(user_id, ':', k) AS slot, event_id, ts, kind, value FROM u""",
    ),
    "merge_composite": Query(
        merge_composite,
        """SELECT l_partkey, l_suppkey,
  CASE WHEN bool_or(l_shipdate >= TIMESTAMP '2000-01-01') THEN 'new' ELSE 'old' END AS seen
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    ),
    "merge_partial_update": Query(
        merge_partial_update,
        f"""WITH {_SPLIT.format(keys='user_id, k')}
SELECT t.user_id, t.k, t.event_id, t.ts,
       CASE WHEN s.user_id IS NOT NULL THEN s.kind ELSE t.kind END AS kind,
       CASE WHEN s.user_id IS NOT NULL THEN s.value ELSE t.value END AS value
FROM t LEFT JOIN s ON s.user_id = t.user_id AND s.k = t.k
UNION ALL
SELECT user_id, k, event_id, ts, kind, value FROM s
WHERE NOT EXISTS (SELECT 1 FROM t WHERE s.user_id = t.user_id AND s.k = t.k)""",
    ),
    "merge_null_keys": Query(
        merge_null_keys,
        f"""WITH {_SPLIT.format(keys='user_id, kind')},
both_ways AS (
  SELECT *, FALSE AS null_safe FROM s
  UNION ALL SELECT *, FALSE FROM t
    WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = t.user_id AND s.kind = t.kind)
  UNION ALL SELECT *, TRUE FROM s
  UNION ALL SELECT *, TRUE FROM t
    WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = t.user_id AND s.kind IS NOT DISTINCT FROM t.kind))
SELECT user_id, kind, event_id, ts, value, null_safe FROM both_ways""",
    ),
    "row_counts": Query(
        table_row_counts,
        "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
    ),
    "preview_limit": Query(
        preview_limit, "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100"
    ),
    "refresh_stream": Query(
        refresh_stream,
        """SELECT * FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
}
