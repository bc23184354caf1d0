"""Jobs on published tables: a history rebuild and the log of a single job."""

from __future__ import annotations

import datetime as dt
import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemart.functions.text import JOB_SEPARATOR
from lakemart.operators.dedupe import latest_per_key
from lakemart.operators.runlog import LOG_COLUMNS, log_start
from lakemart.operators.scd2 import OPEN_END, scd2_rebuild
from lakemart.sources.storage import append, publish_history, read_current
from lakemart.sources.tables import read_table

_LOG = logging.getLogger("lakemart")


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)


def rebuild_history(
    spark: SparkSession,
    source: str,
    target: str,
    key: str,
    updated: str,
    tracked: list[str],
    created: str | None = None,
    end: str = OPEN_END,
    ties: tuple[str, ...] = (),
) -> int:
    """Rebuild a type 2 table from a change log table and switch to it; rows written.

    Readers see the old history until the new one is complete. An error is
    raised and leaves the old history in place.
    """
    built = scd2_rebuild(read_table(spark, source), key, updated, tracked, created, end, ties)
    return publish_history(built, target, F.col("is_active"), restart=True)


@dataclass
class JobLog:
    """Logs one job: a RUNNING row at the start and the full row at the end.

    Rows are only added; ``settled`` shows the last row of every job. A failure
    to log is reported as a warning and does not stop the job.
    """

    spark: SparkSession
    table: str
    qualified_name: str
    user: str = "loader"
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    clock: Callable[[], dt.datetime] = _utc_now

    def __post_init__(self) -> None:
        self.job_id = f"{self.run_id}{JOB_SEPARATOR}{self.qualified_name}"
        self._begun = time.monotonic()
        self._started = None

    def start(self, params: dict | None = None, level: str = "INFO") -> str:
        job = self.spark.createDataFrame(
            [(self.run_id, self.qualified_name, self.qualified_name, json.dumps(params or {}))],
            "run_id string, node string, qualified_name string, input_params string",
        )
        self._started = log_start(job, self.clock(), self.user, level)
        self._write(self._started)
        self.step("start", f"{self.qualified_name} started")
        return self.job_id

    def step(self, name: str, message: str, level: str = "INFO") -> None:
        _LOG.log(logging.getLevelName(level), "[%s] [%s] %s", self.job_id, name, message)

    def error(self, message: str, step: str = "error") -> None:
        self.step(step, message, "ERROR")

    def end(self, status: str, rows: int = 0, message: str | None = None) -> dict:
        """Log the end; what the log row now says of it."""
        if self._started is None:
            raise RuntimeError("the job has not been started")
        seconds = round(time.monotonic() - self._begun, 3)
        written = {
            "end_time": str(self.clock()),
            "duration_seconds": seconds,
            "status": status,
            "rows_processed": rows,
            "message": message,
        }
        filled = [F.lit(written[c]) if c in written else F.col(c) for c in LOG_COLUMNS]
        self._write(self._started.select(*[v.cast(kind).alias(c) for v, (c, kind) in zip(filled, LOG_COLUMNS.items())]))
        self.step("end", f"{status}, {seconds}s, {rows} rows", "ERROR" if status == "FAILED" else "INFO")
        return written

    def _write(self, rows: DataFrame) -> None:
        try:
            append(rows, self.table)
        except Exception as error:  # the job goes on without its log
            _LOG.warning("[%s] not logged: %s", self.job_id, error)


def settled(log: DataFrame) -> DataFrame:
    """One row per job: its end where it has ended, else its start.

    Of ends at the same time the one with the longer duration counts, then status and rows decide.
    """
    return latest_per_key(log, "job_id", "end_time", ("duration_seconds", "status", "rows_processed"))


def read_log(spark: SparkSession, table: str) -> DataFrame:
    return settled(read_current(spark, table))
