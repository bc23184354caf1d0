"""Queries: data checks, ledger, audit, date dimension and star rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.operators.calendar import date_dimension, days_between
from lakemart.operators.ledger import altered_rows, due_items, ledger_rows
from lakemart.operators.quality import (
    code_or_fallback,
    duplicate_keys,
    forbidden_tokens,
    forbidden_words,
    missing_values,
    outside_allowed,
    pattern_violations,
    unmapped_codes,
)
from lakemart.operators.star import eager_rollup
from lakemart.plans.inputs import Query
from lakemart.sources.tables import read_parquet

# What the checks look for.
NAME_PATTERN = "^[a-m][a-z]* [a-z]+$"
FORBIDDEN = ["license", "licensed", "password", "secret", "copyright"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
CODES = [("view_log", "vw"), ("click_log", "ck"), ("error_log", "er")]


def duplicates(spark: SparkSession, folder: str) -> DataFrame:
    items = read_parquet(spark, folder, "lineitem")
    place = F.concat_ws(":", "l_partkey", "l_suppkey")
    return duplicate_keys(items, ["l_orderkey", "l_linenumber"], place)


def pattern(spark: SparkSession, folder: str) -> DataFrame:
    return pattern_violations(read_parquet(spark, folder, "part").select("p_partkey", "p_name"), "p_name", NAME_PATTERN)


def forbidden(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "source", "text")
    return forbidden_tokens(documents, "text", FORBIDDEN).select("doc_id", "source")


def forbidden_by_table(spark: SparkSession, folder: str) -> DataFrame:
    """How many different words of test items each document holds; the table of words grows with the items."""
    items = read_parquet(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("word"))
    found = forbidden_words(read_parquet(spark, folder, "documents"), ["doc_id", "source"], "text", items, "word")
    return found.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("words"))


def required(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("").alias("o_orderpriority"),
    )
    return missing_values(orders, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


def allowed(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return outside_allowed(orders, "o_orderpriority", PRIORITIES)


def _codes(spark: SparkSession) -> DataFrame:
    pairs = [F.struct(F.lit(name).alias("name"), F.lit(code).alias("code")) for name, code in CODES]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def _event_names(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "events").select(
        "event_id", F.concat("event_type", F.lit("_log")).alias("name")
    )


def unmapped(spark: SparkSession, folder: str) -> DataFrame:
    return unmapped_codes(_event_names(spark, folder), "name", _codes(spark), "name")


def lookup(spark: SparkSession, folder: str) -> DataFrame:
    return code_or_fallback(_event_names(spark, folder), "name", _codes(spark), "name", "code")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger knows English and German documents; those of source src1 as they were before."""
    documents = read_parquet(spark, folder, "documents")
    older = F.when(F.col("source") == "src1", F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))
    applied = documents.where(F.col("lang").isin("en", "de")).withColumn("text", older)
    return due_items(documents, ledger_rows(applied, "doc_id", ["text"]), "doc_id", ["text"])


def audit(spark: SparkSession, folder: str) -> DataFrame:
    part = read_parquet(spark, folder, "part")
    raised = F.when(F.col("p_type") == "ECONOMY", F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    return altered_rows(part, part.withColumn("p_retailprice", raised), "p_partkey", ["p_name", "p_retailprice"])


def dates(spark: SparkSession, folder: str) -> DataFrame:
    return date_dimension(days_between(read_parquet(spark, folder, "lineitem"), "l_shipdate"))


def star(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity and amount by brand, nation and quarter of shipping."""
    items = read_parquet(spark, folder, "lineitem")
    fact = items.select(
        F.col("l_partkey").alias("p_partkey"),
        F.col("l_suppkey").alias("s_suppkey"),
        F.col("l_shipdate").cast("date").alias("date"),
        "l_returnflag",
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    nation = read_parquet(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    supplier = read_parquet(spark, folder, "supplier").select("s_suppkey", "s_nationkey").join(nation, "s_nationkey").drop("s_nationkey")
    calendar = date_dimension(days_between(items, "l_shipdate")).select("date", "year", "quarter")
    rolled = eager_rollup(
        fact,
        # at most 3.7 million days exist, so the calendar may be broadcast whatever the fact's size
        [(F.broadcast(calendar), "date"), (supplier, "s_suppkey")],
        [(read_parquet(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey")],
        ["l_returnflag", "p_brand", "n_name", "year", "quarter"],
        ["quantity", "amount"],
    )
    return rolled.withColumns({c: F.col(c).cast("decimal(28,2)") for c in ("quantity", "amount")})


_WORDS = r"(^|[^\p{L}\p{N}_])(" + "|".join(FORBIDDEN) + r")($|[^\p{L}\p{N}_])"

_DATES = """SELECT 1 + date_diff('day', first, date) AS date_sk, date,
  CAST(day(date) AS INTEGER) AS day, CAST(month(date) AS INTEGER) AS month, monthname(date) AS month_name,
  CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
  CAST(isodow(date) AS INTEGER) AS day_of_week, dayname(date) AS day_name, isodow(date) >= 6 AS is_weekend,
  date = last_day(date) AS is_month_end, day(date) = 1 AS is_month_start,
  date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS is_quarter_end,
  day(date) = 1 AND month(date) IN (1, 4, 7, 10) AS is_quarter_start
FROM (SELECT first, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem) b) d"""

QUERIES = {
    "dq_duplicates": Query(
        duplicates,
        """SELECT l_orderkey, l_linenumber, n, concat(l_partkey, ':', l_suppkey) AS place
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) c WHERE n > 1""",
    ),
    "dq_pattern": Query(
        pattern, f"SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '{NAME_PATTERN}')"
    ),
    "dq_forbidden": Query(
        forbidden, f"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '{_WORDS}', 'i')"
    ),
    "dq_forbidden_words": Query(
        forbidden_by_table,
        r"""WITH held AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents),
listed AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM benchmark)
SELECT doc_id, source, count(*) AS words FROM held JOIN listed USING (word) GROUP BY doc_id, source""",
    ),
    "dq_required": Query(
        required,
        """SELECT 'o_orderkey' AS column_name, count(*) FILTER (WHERE o_orderkey IS NULL) AS missing FROM orders
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority = '5-LOW') FROM orders""",
    ),
    "dq_allowed": Query(
        allowed,
        """SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')""",
    ),
    "dq_unmapped": Query(
        unmapped,
        """SELECT DISTINCT upper(event_type || '_log') AS value FROM events
WHERE event_type NOT IN ('view', 'click', 'error')""",
    ),
    "lookup_fallback": Query(
        lookup,
        """SELECT event_id, event_type || '_log' AS name,
  CASE event_type WHEN 'view' THEN 'VW' WHEN 'click' THEN 'CK' WHEN 'error' THEN 'ER'
    ELSE replace(upper(event_type || '_log'), '_', '') END AS code
FROM events""",
    ),
    "ledger_pending": Query(
        ledger,
        """SELECT doc_id, 'pending' AS reason FROM documents WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT doc_id, 'changed' FROM documents WHERE lang IN ('en', 'de') AND source = 'src1'""",
    ),
    "audit_immutable": Query(audit, "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'"),
    "date_dimension": Query(dates, _DATES),
    "star_rollup": Query(
        star,
        """SELECT l_returnflag, p_brand, n_name, CAST(year(l_shipdate) AS INTEGER) AS year,
  CAST(quarter(l_shipdate) AS INTEGER) AS quarter, count(*) AS rows,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
GROUP BY l_returnflag, p_brand, n_name, year(l_shipdate), quarter(l_shipdate)""",
    ),
}
