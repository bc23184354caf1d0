"""Queries: the declared tables, run twice over landing tables made of the given ones.

The first run sees the rows before a cut, the second all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.plans.daily_load import DailyLoad
from lakemart.plans.inputs import CHANGE_LOG_SQL, CLOCK, FIRST_CUT, ORDER_CUT, Query, before, change_log
from lakemart.session import work_folder
from lakemart.sources.landing import conform
from lakemart.sources.tables import read_parquet


def _stamped(moment: str, load: str = "load_time") -> list[Column]:
    return [F.col(moment).alias(c) for c in ("created_at", "updated_at", load)]


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderstatus").alias("sync_token"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("company_name"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("fully_qualified_name"),
        F.col("o_totalprice").alias("balance"),
        *_stamped("o_orderdate"),
    )


def deals(spark: SparkSession, folder: str) -> DataFrame:
    return change_log(spark, folder).select(
        F.col("user_id").alias("deal_id"),
        F.col("kind").alias("dealstage"),
        F.col("value").alias("amount"),
        F.nullif("k", F.lit(0)).alias("mdc_quote_id"),
        F.col("event_id").alias("hs_acv"),
        *_stamped("ts"),
    )


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("quote_id"),
        F.col("l_returnflag").alias("hs_status"),
        F.nullif("l_linestatus", F.lit("O")).alias("hs_payment_status"),
        *_stamped("l_shipdate"),
    )


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").cast("string").alias("doc_number"),
        F.col("o_totalprice").alias("total_tax"),
        *_stamped("o_orderdate"),
    )


def invoice_relation(spark: SparkSession, folder: str) -> DataFrame:
    return change_log(spark, folder).select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("invoice_id"),
        F.col("kind").alias("external_id"),
        *_stamped("ts", "transform_ts"),
    )


def pairs(second: str) -> Callable[[SparkSession, str], DataFrame]:
    def landed(spark: SparkSession, folder: str) -> DataFrame:
        return read_parquet(spark, folder, "lineitem").select(
            F.col("l_partkey").alias("quote_id"), F.col("l_suppkey").alias(second), F.col("l_shipdate").alias("at")
        )

    return landed


# landing table -> rows, their time column, the cut between the two runs
LANDED = {
    "customers": (customers, "load_time", ORDER_CUT),
    "deals": (deals, "load_time", FIRST_CUT),
    "parsed_quotes": (quotes, "load_time", ORDER_CUT),
    "qb_invoices": (invoices, "load_time", ORDER_CUT),
    "invoice_relation": (invoice_relation, "transform_ts", FIRST_CUT),
    "assoc_quotes_companies": (pairs("company_id"), "at", ORDER_CUT),
    "assoc_quotes_deals": (pairs("deal_id"), "at", ORDER_CUT),
}


def _two_runs(source: str, result: str, columns: list[str]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows, time, cut = LANDED[source]
        landed = rows(spark, folder)
        place = work_folder(spark, "warehouse")
        load = DailyLoad(
            spark, lambda name: conform(before(landed, time, cut), name), location=place, suffix=place[-12:]
        )
        load.run(ORDER_CUT, {source, result})
        load.landing = lambda name: conform(landed, name)
        load.run(CLOCK, {source, result})
        return spark.table(load.table("transform" if source == result else "consumption", result)).select(*columns)

    return run


_DEALS = f"""{CHANGE_LOG_SQL},
d AS (SELECT user_id AS deal_id, nullif(k, 0) AS quote_id, kind AS dealstage,
        CAST(value AS DECIMAL(18,2)) AS amount, CAST(event_id AS DECIMAL(18,2)) AS acv,
        ts AS created_dt, ts AS updated_dt, CAST(ts AS DATE) AS load_dt FROM e)"""


def _versions_sql(rows: str, key: str, tracked: list[str], passed: list[str], cut: str, order: str) -> str:
    """First load, closing and the load of unseen versions, in SQL."""
    columns = ", ".join([key, *tracked, *passed])
    t_columns = ", ".join(f"t.{c}" for c in [key, *tracked, *passed])
    differs = " OR ".join(f"s.{c} IS DISTINCT FROM t.{c}" for c in tracked)
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in tracked)
    newest = f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"
    opened = "updated_dt AS start_dt, TIMESTAMP '9999-12-31' AS end_dt, TRUE AS is_active"
    return f"""WITH {rows},
seeded AS (SELECT {columns}, {opened} FROM d WHERE updated_dt < TIMESTAMP '{cut}' {newest}),
newest AS (SELECT * FROM d {newest}),
closed AS (SELECT {t_columns}, t.start_dt,
    CASE WHEN s.{key} IS NOT NULL THEN s.updated_dt ELSE t.end_dt END AS end_dt, s.{key} IS NULL AS is_active
  FROM seeded t LEFT JOIN newest s ON s.{key} = t.{key} AND ({differs})),
unseen AS (SELECT * FROM d s WHERE NOT EXISTS (SELECT 1 FROM closed t WHERE s.{key} = t.{key} AND {same}))
SELECT * FROM closed UNION ALL (SELECT {columns}, {opened} FROM unseen {newest})"""


_VERSION = ["start_dt", "end_dt", "is_active"]

QUERIES = {
    "model_transform_deals": Query(
        _two_runs("deals", "deals", ["deal_id", "quote_id", "dealstage", "amount", "updated_dt", "dealsource", "load_dt"]),
        f"WITH {_DEALS} SELECT deal_id, quote_id, dealstage, amount, updated_dt, '' AS dealsource, load_dt FROM d",
    ),
    "model_transform_customers": Query(
        _two_runs(
            "customers",
            "customers",
            ["customer_id", "sync_token", "company_name", "balance", "notes", "sales_term_id", "updated_dt", "load_dt"],
        ),
        """SELECT o_custkey AS customer_id, o_orderstatus AS sync_token,
  coalesce(nullif(o_orderpriority, '5-LOW'), concat('customer ', o_custkey)) AS company_name,
  CAST(o_totalprice AS DECIMAL(18,2)) AS balance, '' AS notes, CAST(0 AS BIGINT) AS sales_term_id,
  CAST(o_orderdate AS DATE) AS updated_dt, CAST(o_orderdate AS DATE) AS load_dt FROM orders""",
    ),
    "model_dim_deals": Query(
        _two_runs("deals", "dim_deals", ["deal_id", "dealstage", "created_dt", "quote_id", "load_dt", *_VERSION]),
        _versions_sql(
            _DEALS, "deal_id", ["dealstage"], ["created_dt", "quote_id", "load_dt"], "2024-01-11", "updated_dt DESC"
        ),
    ),
    "model_dim_quotes": Query(
        _two_runs("parsed_quotes", "dim_quotes", ["quote_id", "status", "payment_status", "load_dt", *_VERSION]),
        _versions_sql(
            """d AS (SELECT l_orderkey AS quote_id, l_returnflag AS status, nullif(l_linestatus, 'O') AS payment_status,
        l_shipdate AS updated_dt, CAST(l_shipdate AS DATE) AS load_dt FROM lineitem)""",
            "quote_id",
            ["status", "payment_status"],
            ["load_dt"],
            "2000-01-01",
            "updated_dt DESC, status DESC NULLS LAST, payment_status DESC NULLS LAST",
        ),
    ),
    "model_fact_deals": Query(
        _two_runs("deals", "fact_deals", ["deal_id", "quote_id", "amount", "acv", "created_dt", "updated_dt", "load_dt"]),
        f"""WITH {_DEALS},
t AS (SELECT * FROM d WHERE updated_dt < TIMESTAMP '2024-01-11'
      QUALIFY row_number() OVER (PARTITION BY deal_id, quote_id ORDER BY updated_dt DESC) = 1),
s AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY deal_id, quote_id ORDER BY updated_dt DESC) = 1),
hit AS (SELECT t.*, s.deal_id IS NOT NULL AS matched, s.amount AS new_amount, s.acv AS new_acv, s.updated_dt AS new_dt
        FROM t LEFT JOIN s ON t.deal_id = s.deal_id AND t.quote_id = s.quote_id)
SELECT deal_id, quote_id, CASE WHEN matched THEN new_amount ELSE amount END AS amount,
  CASE WHEN matched THEN new_acv ELSE acv END AS acv, created_dt,
  CASE WHEN matched THEN new_dt ELSE updated_dt END AS updated_dt, load_dt FROM hit
UNION ALL SELECT deal_id, quote_id, amount, acv, created_dt, updated_dt, load_dt FROM s
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.deal_id = s.deal_id AND t.quote_id = s.quote_id)""",
    ),
    "model_dim_invoices": Query(
        _two_runs("qb_invoices", "dim_invoices", ["id", "doc_number", "total_tax", "bill_email", "updated_dt"]),
        """SELECT o_custkey AS id, CAST(o_orderkey AS VARCHAR) AS doc_number,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total_tax, '' AS bill_email, CAST(o_orderdate AS DATE) AS updated_dt
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1""",
    ),
    "model_dim_invoice_relation": Query(
        _two_runs("invoice_relation", "dim_invoice_relation", ["id", "invoice_id", "external_id", "updated_dt", "load_dt"]),
        f"""WITH {CHANGE_LOG_SQL}
SELECT event_id AS id, user_id AS invoice_id, kind AS external_id, ts AS updated_dt, CAST(ts AS DATE) AS load_dt
FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""",
    ),
    "model_dim_assoc_quotes_companies": Query(
        _two_runs("assoc_quotes_companies", "dim_assoc_quotes_companies", ["quote_id", "company_id"]),
        "SELECT DISTINCT l_partkey AS quote_id, l_suppkey AS company_id FROM lineitem",
    ),
    "model_dim_assoc_quotes_deals": Query(
        _two_runs("assoc_quotes_deals", "dim_assoc_quotes_deals", ["quote_id", "deal_id"]),
        "SELECT DISTINCT l_partkey AS quote_id, l_suppkey AS deal_id FROM lineitem",
    ),
    "model_dim_customers": Query(
        _two_runs(
            "customers",
            "dim_customers",
            ["customer_id", "sync_token", "company_name", "balance", "updated_dt", "valid_from", "valid_to"],
        ),
        """WITH d AS (SELECT o_custkey AS customer_id, o_orderstatus AS sync_token,
  coalesce(nullif(o_orderpriority, '5-LOW'), concat('customer ', o_custkey)) AS company_name,
  CAST(o_totalprice AS DECIMAL(18,2)) AS balance, CAST(o_orderdate AS DATE) AS updated_dt FROM orders),
b1 AS (SELECT * FROM d WHERE updated_dt < DATE '2000-01-01' QUALIFY row_number() OVER (
  PARTITION BY customer_id ORDER BY updated_dt DESC, sync_token DESC, company_name DESC, balance DESC) = 1),
b2 AS (SELECT * FROM d QUALIFY row_number() OVER (
  PARTITION BY customer_id ORDER BY updated_dt DESC, sync_token DESC, company_name DESC, balance DESC) = 1)
SELECT b1.*, TIMESTAMP '2000-01-01' AS valid_from,
  CASE WHEN b1.sync_token = b2.sync_token AND b1.company_name = b2.company_name AND b1.balance = b2.balance
    AND b1.updated_dt = b2.updated_dt THEN TIMESTAMP '9999-12-31' ELSE TIMESTAMP '2024-02-01 06:30:00' END AS valid_to
FROM b1 JOIN b2 USING (customer_id)
UNION ALL SELECT b2.*, TIMESTAMP '2024-02-01 06:30:00', TIMESTAMP '9999-12-31'
FROM b2 LEFT JOIN b1 USING (customer_id)
WHERE b1.customer_id IS NULL OR b1.sync_token <> b2.sync_token OR b1.company_name <> b2.company_name
  OR b1.balance <> b2.balance OR b1.updated_dt <> b2.updated_dt""",
    ),
}
