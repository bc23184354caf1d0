"""Queries: type 2 history and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.operators.dedupe import latest_per_key
from lakemart.operators.ordered import ordered_rows, with_next, with_position, with_previous, with_running_total
from lakemart.operators.scd2 import change_streak, scd2_close, scd2_incremental, scd2_rebuild, scd2_seed
from lakemart.operators.snapshot import snapshot_check
from lakemart.plans.inputs import (
    CHANGE_LOG_SQL,
    CLOCK,
    FIRST_CUT,
    ORDER_CUT,
    Query,
    before,
    change_log,
    since,
)
from lakemart.sources.tables import read_parquet

HISTORY = {"key": "user_id", "updated": "ts", "tracked": ["kind"], "ties": ("event_id",)}
KEPT = ("event_id", "value")


def sequence(spark: SparkSession, folder: str) -> DataFrame:
    """All events as the rows of one key: the row before, the time after, the sum so far and the place."""
    events = read_parquet(spark, folder, "events").select(
        F.lit(1).alias("stream"), "event_id", "ts", "event_type", F.col("value").cast("decimal(18,4)").alias("amount")
    )
    rows = with_next(with_previous(ordered_rows(events, "stream", "ts", ("event_id",)), ["event_type"]))
    rows = with_position(with_running_total(rows, F.col("amount"), "so_far"), "place")
    return rows.result().select(
        "event_id", F.col("_prev.event_type").alias("type_before"), F.col("_next").alias("ts_after"),
        F.col("so_far").cast("decimal(28,4)").alias("so_far"), "place",
    )


def _seed(log: DataFrame) -> DataFrame:
    return scd2_seed(before(log, "ts", FIRST_CUT), passthrough=KEPT, **HISTORY)


def seed(spark: SparkSession, folder: str) -> DataFrame:
    return _seed(change_log(spark, folder))


def close(spark: SparkSession, folder: str) -> DataFrame:
    log = change_log(spark, folder)
    return scd2_close(_seed(log), log, **HISTORY)


def incremental(spark: SparkSession, folder: str) -> DataFrame:
    log = change_log(spark, folder)
    return scd2_incremental(_seed(log), log, passthrough=KEPT, match_scope="any", **HISTORY)


def incremental_fixed(spark: SparkSession, folder: str) -> DataFrame:
    log = change_log(spark, folder)
    return scd2_incremental(_seed(log), log, passthrough=KEPT, match_scope="active", **HISTORY)


def rebuild(spark: SparkSession, folder: str) -> DataFrame:
    return scd2_rebuild(
        change_log(spark, folder), "user_id", "ts", ["kind", "high"], created="event_id", ties=("event_id",)
    )


def rebuild_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return scd2_rebuild(
        change_log(spark, folder), "user_id", "ts", ["kind"], ties=("event_id",), keep_first=True
    )


def streak(spark: SparkSession, folder: str) -> DataFrame:
    return change_streak(change_log(spark, folder), "user_id", "ts", ["kind", "high"], ("event_id",))


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs; customers without an order since the cut are missing from the second."""
    orders = read_parquet(spark, folder, "orders")
    checked = ["o_orderstatus", "o_orderpriority"]
    first, second = (
        latest_per_key(part, "o_custkey", "o_orderdate", ("o_orderkey",))
        for part in (before(orders, "o_orderdate", ORDER_CUT), since(orders, "o_orderdate", ORDER_CUT))
    )
    stored = snapshot_check(None, first, "o_custkey", checked, ORDER_CUT)
    return snapshot_check(stored, second, "o_custkey", checked, CLOCK)


_NEWEST = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
_OPEN = "ts AS start_dt, TIMESTAMP '9999-12-31' AS end_dt, TRUE AS is_active"

_CLOSED = f"""{CHANGE_LOG_SQL},
seeded AS (SELECT user_id, kind, event_id, value, {_OPEN} FROM e
           WHERE ts < TIMESTAMP '2024-01-11' {_NEWEST}),
newest AS (SELECT * FROM e {_NEWEST}),
closed AS (
  SELECT t.user_id, t.kind, t.event_id, t.value, t.start_dt,
         CASE WHEN s.user_id IS NOT NULL THEN s.ts ELSE t.end_dt END AS end_dt,
         s.user_id IS NULL AS is_active
  FROM seeded t LEFT JOIN newest s ON s.user_id = t.user_id AND s.kind IS DISTINCT FROM t.kind)"""


def _changes_sql(tracked: list[str], keep_first: bool = False) -> str:
    """Rows whose content is not that of the row numbered one less."""
    now, then = (f"row({', '.join(f'{side}.{c}' for c in tracked)})" for side in ("e", "p"))
    first = " OR e.n = 1" if keep_first else ""
    return f"""{CHANGE_LOG_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e),
changes AS (SELECT e.* FROM numbered e LEFT JOIN numbered p ON p.user_id IS NOT DISTINCT FROM e.user_id AND p.n = e.n - 1
            WHERE {now} IS DISTINCT FROM {then}{first})"""


_CHAINED = """coalesce(lead(ts) OVER w, TIMESTAMP '9999-12-31') AS end_dt, lead(ts) OVER w IS NULL AS is_active
FROM changes WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

QUERIES = {
    "event_sequence": Query(
        sequence,
        """SELECT event_id, lag(event_type) OVER w AS type_before, lead(ts) OVER w AS ts_after,
  CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (ORDER BY ts) AS DECIMAL(28,4)) AS so_far, row_number() OVER w AS place
FROM events WINDOW w AS (ORDER BY ts, event_id)""",
    ),
    "scd2_seed": Query(
        seed,
        f"""WITH {CHANGE_LOG_SQL} SELECT user_id, kind, event_id, value, {_OPEN} FROM e
WHERE ts < TIMESTAMP '2024-01-11' {_NEWEST}""",
    ),
    "scd2_close": Query(close, f"WITH {_CLOSED} SELECT * FROM closed"),
    "scd2_incremental": Query(
        incremental,
        f"""WITH {_CLOSED},
unseen AS (SELECT * FROM e WHERE NOT EXISTS (
             SELECT 1 FROM closed t WHERE t.user_id = e.user_id AND t.kind IS NOT DISTINCT FROM e.kind))
SELECT * FROM closed
UNION ALL (SELECT user_id, kind, event_id, value, {_OPEN} FROM unseen {_NEWEST})""",
    ),
    "scd2_incremental_fixed": Query(
        incremental_fixed,
        f"""WITH {_CLOSED}
SELECT * FROM closed
UNION ALL SELECT user_id, kind, event_id, value, {_OPEN} FROM newest s WHERE NOT EXISTS (
  SELECT 1 FROM closed t WHERE t.is_active AND t.user_id = s.user_id AND t.kind IS NOT DISTINCT FROM s.kind)""",
    ),
    "scd2_rebuild": Query(
        rebuild,
        f"""WITH {_changes_sql(['kind', 'high'])}
SELECT user_id, kind, high, event_id, ts, ts AS start_dt, {_CHAINED}""",
    ),
    "scd2_rebuild_keep_first": Query(
        rebuild_keep_first,
        f"""WITH {_changes_sql(['kind'], keep_first=True)}
SELECT user_id, kind, ts, ts AS start_dt, {_CHAINED}""",
    ),
    "change_streak": Query(
        streak,
        f"""WITH {_changes_sql(['kind', 'high'])}
SELECT user_id, ts, kind, high, count(*) OVER (PARTITION BY user_id ORDER BY ts) AS streak FROM changes""",
    ),
    "snapshot_check": Query(
        snapshot,
        """WITH b1 AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
b2 AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
versions AS (
  SELECT b1.*, TIMESTAMP '2000-01-01' AS valid_from,
    CASE WHEN b2.o_custkey IS NOT NULL THEN TIMESTAMP '2024-02-01 06:30:00'
         ELSE TIMESTAMP '9999-12-31' END AS valid_to
  FROM b1 LEFT JOIN b2 ON b1.o_custkey = b2.o_custkey
    AND (b1.o_orderstatus <> b2.o_orderstatus OR b1.o_orderpriority <> b2.o_orderpriority)
  UNION ALL
  SELECT b2.*, TIMESTAMP '2024-02-01 06:30:00', TIMESTAMP '9999-12-31'
  FROM b2 LEFT JOIN b1 ON b1.o_custkey = b2.o_custkey
    AND b1.o_orderstatus = b2.o_orderstatus AND b1.o_orderpriority = b2.o_orderpriority
  WHERE b1.o_custkey IS NULL)
SELECT *, valid_from AS updated_at,
  md5(concat_ws('|', CAST(o_custkey AS VARCHAR), strftime(valid_from, '%Y-%m-%d %H:%M:%S'))) AS version_id
FROM versions""",
    ),
}
