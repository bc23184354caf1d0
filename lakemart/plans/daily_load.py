"""One run over the declared tables: load, merge, log, report."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lakemart.operators.incremental import EMPTY_TARGET_MARK, high_water, newer_than
from lakemart.operators.report import run_report
from lakemart.operators.runlog import log_rows, rows_of_run
from lakemart.plans.jobs import read_log
from lakemart.plans.models import CONSUMPTION, TRANSFORMS, Snapshot, Transform, Versioned
from lakemart.sources.layers import database
from lakemart.sources.storage import (
    append,
    create_database,
    exists,
    newest_partition,
    publish,
    publish_history,
    read_current,
    read_open,
)

RESULT_SCHEMA = (
    "run_id string, node string, name string, database string, schema string, "
    "status string, duration double, rows long, message string"
)


@dataclass
class DailyLoad:
    """Loads the landing tables of one environment through the layers.

    ``landing`` hands out a landing table by name. Tables are taken in lineage
    order. A failing table does not stop the run: it is logged as failed and the
    tables built on it are skipped.
    """

    spark: SparkSession
    landing: Callable[[str], DataFrame]
    environment: str = "dev"
    user: str = "loader"
    location: str | None = None
    suffix: str | None = None
    full_refresh: bool = False
    loaded_since: dt.date | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def table(self, layer: str, name: str) -> str:
        return f"{database(self.environment, layer, self.suffix)}.{name}"

    @property
    def log_table(self) -> str:
        return self.table("raw", "log_history")

    def create_databases(self) -> None:
        for layer in ("raw", "transform", "consumption"):
            name = database(self.environment, layer, self.suffix)
            create_database(self.spark, name, f"{self.location}/{name}" if self.location else None)

    def run(self, clock: dt.datetime, only: set[str] | None = None) -> dict[str, str]:
        """Load all tables (or those named), log every node, return each table's status."""
        self.create_databases()
        results, failed = [], set()
        for name, model in {**TRANSFORMS, **CONSUMPTION}.items():
            if only is not None and name not in only:
                continue
            layer = "transform" if isinstance(model, Transform) else "consumption"
            if layer == "consumption" and model.source in failed:
                failed.add(name)
                results.append(self._result(layer, name, "skipped", 0.0, 0, None))
                continue
            begun = time.monotonic()
            try:
                rows = self.load(name) if layer == "transform" else self.consume(name, clock)
                status, message = "success", None
            except Exception as error:  # every node is logged, failed ones with their text
                failed.add(name)
                rows, status, message = 0, "error", str(error)
            results.append(self._result(layer, name, status, time.monotonic() - begun, rows, message))
        finished = self.spark.createDataFrame(results, RESULT_SCHEMA)
        append(log_rows(finished, clock, self.user), self.log_table)
        return {row[2]: row[5] for row in results}

    def report(self) -> DataFrame:
        """The report of this run, read from the log, a row per job."""
        return run_report(rows_of_run(read_log(self.spark, self.log_table), self.run_id))

    def load(self, name: str) -> int:
        """Bring one transform table up to date; rows written."""
        model, table = TRANSFORMS[name], self.table("transform", name)
        landed = self.landing(name)
        if model.load_time is None:
            return publish(model.clean(landed), table)
        parts = (model.load_column,) if model.by_day else ()
        if self.full_refresh or not exists(self.spark, table):
            rows = model.clean(landed)
            # rows of one day are brought together, so that a day's folder holds few files
            return publish(rows.hint("rebalance", *parts) if parts else rows, table, parts)
        if model.by_day:
            mark = newest_partition(self.spark, table, model.load_column) or EMPTY_TARGET_MARK
        else:
            mark = high_water(read_current(self.spark, table), model.load_column)
        return append(model.clean(landed.where(newer_than(model.load_time, mark))), table, parts)

    def consume(self, name: str, clock: dt.datetime) -> int:
        """Build the next state of one consumption table; rows written.

        ``loaded_since`` limits merges to rows loaded from that day on. Type 2
        dimensions and snapshots always see their whole source.
        """
        model, table = CONSUMPTION[name], self.table("consumption", name)
        source = read_current(self.spark, self.table("transform", model.source))
        if source is None:
            raise RuntimeError(f"{model.source} has not been loaded")
        target = None if self.full_refresh else read_current(self.spark, table)
        if isinstance(model, (Versioned, Snapshot)):
            if target is None:
                return publish_history(model.first(source, clock), table, model.is_open, restart=True)
            delta = model.delta(read_open(self.spark, table), target, source, clock)
            return publish_history(delta, table, model.is_open)
        new_only = bool(self.loaded_since) and target is not None and "load_dt" in source.columns
        if new_only:
            source = source.where(source.load_dt >= self.loaded_since)
        return publish(model.build(target, source, new_only), table)

    def _result(self, layer: str, name: str, status: str, seconds: float, rows: int, message: str | None) -> tuple:
        place, _, _ = self.table(layer, name).rpartition(".")
        return (self.run_id, f"model.{name}", name, place, None, status, round(seconds, 3), rows, message)
