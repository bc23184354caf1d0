"""The job log: one row per node and run, and its summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.functions.clean import zero_if_null
from lakemart.functions.text import belongs_to_run, job_id, log_message, log_status, run_of, split_name
from lakemart.operators.merge import merge_state

# The log's columns in order, and the columns written at the end of a job.
LOG_COLUMNS = {
    "job_id": "string",
    "sp_name": "string",
    "sp_database": "string",
    "sp_schema": "string",
    "input_params": "variant",
    "log_level": "string",
    "start_time": "timestamp_ntz",
    "status": "string",
    "executed_by": "string",
    "end_time": "timestamp_ntz",
    "duration_seconds": "double",
    "rows_processed": "long",
    "message": "string",
}
END_COLUMNS = ["end_time", "duration_seconds", "status", "rows_processed", "message"]


def _log_rows(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(
        *[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in LOG_COLUMNS.items()]
    )


def _moment(value: dt.datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def log_rows(results: DataFrame, clock: dt.datetime | Column, user: str) -> DataFrame:
    """Finished nodes as log rows, failures included.

    ``results``: run_id, node, name, database, schema, status, duration, rows,
    message. The start is the clock minus the duration in whole seconds.
    """
    now = _moment(clock)
    seconds = zero_if_null(F.col("duration").cast("double"))
    return _log_rows(
        results,
        {
            "job_id": job_id("run_id", "node"),
            "sp_name": F.col("name"),
            "sp_database": F.col("database"),
            "sp_schema": F.col("schema"),
            "log_level": F.lit("INFO"),
            "start_time": now - F.make_dt_interval(secs=F.round(seconds, 0).cast("decimal(18,6)")),
            "status": log_status("status"),
            "executed_by": F.lit(user),
            "end_time": now,
            "duration_seconds": seconds,
            "rows_processed": zero_if_null(F.col("rows").cast("long")),
            "message": log_message("message"),
        },
    )


def log_start(jobs: DataFrame, clock: dt.datetime | Column, user: str, level: str = "INFO") -> DataFrame:
    """RUNNING rows for jobs given as run_id, node, qualified_name, input_params (JSON text)."""
    return _log_rows(
        jobs,
        {
            "job_id": job_id("run_id", "node"),
            **split_name("qualified_name"),
            "input_params": F.try_parse_json(F.coalesce("input_params", F.lit("{}"))),
            "log_level": F.lit(level),
            "start_time": _moment(clock),
            "status": F.lit("RUNNING"),
            "executed_by": F.lit(user),
        },
    )


def log_end(log: DataFrame, endings: DataFrame) -> DataFrame:
    """The log after jobs ended; ``endings`` holds job_id and the five end columns.

    Endings of unknown jobs change nothing.
    """
    missing = [c for c in log.columns if c not in endings.columns]
    padded = endings.select(
        *[F.lit(None).cast(log.schema[c].dataType).alias(c) if c in missing else F.col(c) for c in log.columns]
    )
    return merge_state(log, padded, ["job_id"], END_COLUMNS, insert_new=False)


def rows_of_run(log: DataFrame, run: str) -> DataFrame:
    return log.where(belongs_to_run("job_id", run))


def run_summary(log: DataFrame) -> DataFrame:
    """Per run: nodes, failed nodes, rows, seconds, start. Partial sums before the shuffle."""
    # a decimal sum does not depend on the order of the rows
    seconds = F.col("duration_seconds").cast("decimal(18,6)")
    return (
        log.withColumn("run_id", run_of("job_id"))
        .where("run_id IS NOT NULL")
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status") == "FAILED").alias("failed"),
            F.coalesce(F.sum("rows_processed"), F.lit(0)).alias("rows_processed"),
            F.coalesce(F.sum(seconds), F.lit(0)).cast("decimal(28,6)").alias("duration_seconds"),
            F.min("start_time").alias("started"),
        )
    )


def run_failures(log: DataFrame) -> DataFrame:
    return log.where((F.col("status") == "FAILED") & run_of("job_id").isNotNull()).withColumn(
        "run_id", run_of("job_id")
    )


def report_choice(log: DataFrame) -> DataFrame:
    """Exactly one kind of report per run: failure if any node failed, else success."""
    return run_summary(log).select(
        "run_id",
        F.when(F.col("failed") > 0, "FAILURE").otherwise("SUCCESS").alias("report"),
        "total",
        "failed",
    )


