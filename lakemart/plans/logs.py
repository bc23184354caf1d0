"""Queries: run log, summaries and reports, over a log derived from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.functions.text import JOB_SEPARATOR, split_name
from lakemart.operators.report import failure_report, run_report, success_report
from lakemart.operators.runlog import (
    log_end,
    log_rows,
    log_start,
    report_choice,
    run_failures,
    run_summary,
)
from lakemart.plans.inputs import CLOCK, Query
from lakemart.sources.tables import read_parquet

# How event types stand for node results, an error text that needs
# escaping, and the length kept of it by the one report that is cut.
NODE_STATUS = {"error": "error", "click": "success", "view": "pass", "signup": "skipped", "purchase": "warn"}
ERROR_TEXT = "Syntax error: a < b && c > d near $$x$$ in <model> "
ERROR_REPEATS = 60
MESSAGE_LENGTH = 1500


def node_results(spark: SparkSession, folder: str) -> DataFrame:
    """A run per user and a node per event; errors carry a long message, others none."""
    kind = F.col("event_type")
    status = F.lit(None)
    for name, result in NODE_STATUS.items():
        status = F.when(kind == name, result).otherwise(status)
    node = F.concat(F.lit("n"), F.col("event_id").cast("string"))
    return read_parquet(spark, folder, "events").select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"),
        node.alias("node"),
        F.when(kind != "signup", F.concat(F.lit("model_"), node)).alias("name"),
        F.lit("dev_transform").alias("database"),
        F.when(kind != "view", F.lit("postgres")).alias("schema"),
        status.alias("status"),
        F.col("value").alias("duration"),
        F.when(kind != "purchase", F.col("event_id")).alias("rows"),
        F.when(kind == "error", F.concat(node, F.lit(": "), F.repeat(F.lit(ERROR_TEXT), F.lit(ERROR_REPEATS)))).alias(
            "message"
        ),
    )


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    return log_rows(node_results(spark, folder), CLOCK, "loader")


def _with_text_params(log: DataFrame) -> DataFrame:
    return log.withColumn("input_params", F.to_json("input_params"))


def log_rows_query(spark: SparkSession, folder: str) -> DataFrame:
    return _with_text_params(run_log(spark, folder))


def log_start_end(spark: SparkSession, folder: str) -> DataFrame:
    """Every event starts a job; all but purchases end."""
    events = read_parquet(spark, folder, "events")
    run = F.concat(F.lit("r"), F.col("user_id").cast("string"))
    node = F.concat(F.lit("n"), F.col("event_id").cast("string"))
    started = log_start(
        events.select(
            run.alias("run_id"),
            node.alias("node"),
            F.concat_ws(".", F.lit("DEV_TRANSFORM"), F.lit("POSTGRES"), node).alias("qualified_name"),
            F.nullif("props", F.lit("")).alias("input_params"),
        ),
        CLOCK,
        "loader",
    )
    ended = events.where("event_type <> 'purchase'").select(
        F.concat(run, F.lit(JOB_SEPARATOR), node).alias("job_id"),
        F.lit("2024-02-01 07:00:00").cast("timestamp_ntz").alias("end_time"),
        F.col("value").alias("duration_seconds"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("event_id").alias("rows_processed"),
        F.col("event_type").alias("message"),
    )
    log = log_end(started, ended)
    return log.withColumn("input_params", F.try_variant_get("input_params", "$.k", "int"))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return run_summary(run_log(spark, folder))


def failures(spark: SparkSession, folder: str) -> DataFrame:
    return run_failures(run_log(spark, folder)).select("run_id", "job_id", "sp_name", "rows_processed", "message")


def choice(spark: SparkSession, folder: str) -> DataFrame:
    return report_choice(run_log(spark, folder))


def report_success(spark: SparkSession, folder: str) -> DataFrame:
    return success_report(run_log(spark, folder))


def report_failure(spark: SparkSession, folder: str) -> DataFrame:
    return failure_report(run_log(spark, folder), message_length=MESSAGE_LENGTH)


def report_single_run(spark: SparkSession, folder: str) -> DataFrame:
    """All events as nodes of one run, with whole messages."""
    log = run_log(spark, folder)
    return run_report(log.withColumn("job_id", F.concat(F.lit("all"), F.lit(JOB_SEPARATOR), "job_id")))


def one_report(spark: SparkSession, folder: str) -> DataFrame:
    return run_report(run_log(spark, folder))


def json_params(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.when(F.col("event_type") == "error", F.lit('{"k": ')).otherwise(F.col("props"))
    parsed = F.try_parse_json(broken)
    return read_parquet(spark, folder, "events").select(
        "event_id", F.try_variant_get(parsed, "$.k", "int").alias("k"), parsed.isNull().alias("is_broken")
    )


def split_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of one, two and three parts, by the part's type."""
    kind = F.col("p_type")
    qualified = (
        F.when(kind.isin("MEDIUM", "SMALL"), F.col("p_name"))
        .when(kind.isin("LARGE", "PROMO"), F.concat_ws(".", "p_brand", "p_name"))
        .otherwise(F.concat_ws(".", "p_brand", "p_type", "p_name"))
    )
    parts = split_name("qualified")
    named = read_parquet(spark, folder, "part").select("p_partkey", qualified.alias("qualified"))
    return named.select("p_partkey", "qualified", *[c.alias(n) for n, c in parts.items()])


_LOG = f"""log AS (
  SELECT concat('r', user_id, '::n', event_id) AS job_id, concat('r', user_id) AS run_id,
    CASE WHEN event_type <> 'signup' THEN concat('model_n', event_id) END AS sp_name,
    'dev_transform' AS sp_database,
    CASE WHEN event_type <> 'view' THEN 'postgres' END AS sp_schema,
    CAST(NULL AS VARCHAR) AS input_params, 'INFO' AS log_level,
    TIMESTAMP '2024-02-01 06:30:00' - to_seconds(CAST(round(value) AS BIGINT)) AS start_time,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'SUCCESS' WHEN 'view' THEN 'SUCCESS'
      WHEN 'signup' THEN 'SKIPPED' WHEN 'purchase' THEN 'WARN' END AS status,
    'loader' AS executed_by, TIMESTAMP '2024-02-01 06:30:00' AS end_time,
    coalesce(value, 0) AS duration_seconds,
    CASE WHEN event_type <> 'purchase' THEN event_id ELSE 0 END AS rows_processed,
    CASE WHEN event_type = 'error' THEN replace(concat('n', event_id, ': ',
      repeat('{ERROR_TEXT}', {ERROR_REPEATS})), '$$', '') ELSE '' END AS message
  FROM events)"""

_SUMMARY = """runs AS (
  SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'FAILED') AS failed,
    CAST(sum(rows_processed) AS BIGINT) AS rows_processed,
    CAST(sum(CAST(duration_seconds AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS duration_seconds,
    min(start_time) AS started
  FROM log GROUP BY run_id)"""

_TARGET = "coalesce(sp_database, '') || '.' || coalesce(sp_schema, '')"
_SECONDS = "CAST(CAST(duration_seconds AS DECIMAL(18,2)) AS VARCHAR)"

_ENTITIES = "replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_RUN = "'<p>Run ID: ' || run_id || '</p>'"
_STARTED = "'<p>Started: ' || strftime(started, '%Y-%m-%d %H:%M:%S') || '</p>'"


def _place(heading: int) -> str:
    """The line of a node below so many heading lines."""
    return f"row_number() OVER (PARTITION BY run_id ORDER BY start_time, job_id) + {heading - 1} AS line"


def _frame_sql(lines: list[str], where: str = "TRUE") -> str:
    texts = [f"SELECT run_id, CAST({n} AS BIGINT) AS line, {text} AS text FROM runs WHERE {where}" for n, text in enumerate(lines)]
    return "\nUNION ALL ".join(texts)


_SUCCESS_LINES = [
    "'Run succeeded (' || total || ' models)'",
    "'<h2>Run succeeded</h2>'",
    _RUN,
    _STARTED,
    "'<p>Models: ' || total || '</p>'",
    "'<p>Total rows: ' || rows_processed || '</p>'",
    f"'<p>Total seconds: ' || {_SECONDS} || '</p>'",
    "'<table><tr><th>Model</th><th>Target</th><th>Status</th><th>Rows</th><th>Seconds</th></tr>'",
]
_SUCCESS = f"""{_frame_sql(_SUCCESS_LINES)}
UNION ALL SELECT run_id, total + {len(_SUCCESS_LINES)}, '</table>' FROM runs
UNION ALL SELECT run_id, {_place(len(_SUCCESS_LINES))}, '<tr><td>' || coalesce(sp_name, '?') || '</td><td>' || {_TARGET}
  || '</td><td>' || coalesce(status, '') || '</td><td>' || rows_processed || '</td><td>' || {_SECONDS} || '</td></tr>'
FROM log"""

_FAILURE_LINES = [
    "'Run failed (' || failed || ' of ' || total || ' models)'",
    "'<h2>Run failed</h2>'",
    _RUN,
    _STARTED,
    "'<p>Failed: ' || failed || ' of ' || total || ' models</p>'",
]


def _failure_sql(message: str) -> str:
    return f"""{_frame_sql(_FAILURE_LINES, "failed > 0")}
UNION ALL SELECT run_id, {_place(len(_FAILURE_LINES))}, '<div><b>' || coalesce(sp_name, '?') || '</b> ' || {_TARGET}
  || ' ' || {_SECONDS} || 's<pre>' || {message} || '</pre></div>'
FROM log WHERE status = 'FAILED'"""


_ONE_PER_RUN = f"""{_SUMMARY}, success AS ({_SUCCESS}), failure AS ({_failure_sql(_ENTITIES)})
SELECT f.*, 'FAILURE' AS report FROM failure f
UNION ALL SELECT s.*, 'SUCCESS' FROM success s WHERE run_id NOT IN (SELECT run_id FROM failure)"""
_SINGLE = _LOG.replace("concat('r', user_id, '::n', event_id)", "concat('all::r', user_id, '::n', event_id)").replace(
    "concat('r', user_id) AS run_id", "'all' AS run_id"
)

QUERIES = {
    "run_log_rows": Query(
        log_rows_query,
        f"""WITH {_LOG} SELECT job_id, sp_name, sp_database, sp_schema, input_params, log_level, start_time,
  status, executed_by, end_time, duration_seconds, rows_processed, message FROM log""",
    ),
    "log_start_end": Query(
        log_start_end,
        """SELECT concat('r', user_id, '::n', event_id) AS job_id, concat('n', event_id) AS sp_name,
  'DEV_TRANSFORM' AS sp_database, 'POSTGRES' AS sp_schema,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS input_params, 'INFO' AS log_level,
  TIMESTAMP '2024-02-01 06:30:00' AS start_time,
  CASE event_type WHEN 'purchase' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  'loader' AS executed_by,
  CASE WHEN event_type <> 'purchase' THEN TIMESTAMP '2024-02-01 07:00:00' END AS end_time,
  CASE WHEN event_type <> 'purchase' THEN value END AS duration_seconds,
  CASE WHEN event_type <> 'purchase' THEN event_id END AS rows_processed,
  CASE WHEN event_type <> 'purchase' THEN event_type END AS message
FROM events""",
    ),
    "run_summary": Query(summary, f"WITH {_LOG}, {_SUMMARY} SELECT * FROM runs"),
    "run_failures": Query(
        failures,
        f"WITH {_LOG} SELECT run_id, job_id, sp_name, rows_processed, message FROM log WHERE status = 'FAILED'",
    ),
    "run_report_choice": Query(
        choice,
        f"""WITH {_LOG}, {_SUMMARY}
SELECT run_id, CASE WHEN failed > 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS report, total, failed FROM runs""",
    ),
    "run_report_success": Query(report_success, f"WITH {_LOG}, {_SUMMARY} {_SUCCESS}"),
    "run_report_failure": Query(
        report_failure, f"WITH {_LOG}, {_SUMMARY} {_failure_sql(f'left({_ENTITIES}, {MESSAGE_LENGTH})')}"
    ),
    "run_report_one_per_run": Query(one_report, f"WITH {_LOG}, {_ONE_PER_RUN}"),
    "run_report_single_run": Query(report_single_run, f"WITH {_SINGLE}, {_ONE_PER_RUN}"),
    "json_params": Query(
        json_params,
        """SELECT event_id,
  CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k,
  event_type = 'error' AS is_broken
FROM events""",
    ),
    "split_name": Query(
        split_names,
        """SELECT p_partkey, q AS qualified, string_split(q, '.')[1] AS sp_database,
  coalesce(string_split(q, '.')[2], '') AS sp_schema, string_split(q, '.')[-1] AS sp_name
FROM (SELECT p_partkey, CASE WHEN p_type IN ('MEDIUM', 'SMALL') THEN p_name
    WHEN p_type IN ('LARGE', 'PROMO') THEN concat_ws('.', p_brand, p_name)
    ELSE concat_ws('.', p_brand, p_type, p_name) END AS q FROM part) n""",
    ),
}
