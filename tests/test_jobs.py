from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakemart.operators.report import run_report
from lakemart.operators.runlog import rows_of_run
from lakemart.plans.jobs import JobLog, read_log, rebuild_history, settled
from lakemart.sources.storage import publish
from lakemart.sources.tables import store_view

OPEN = dt.datetime(9999, 12, 31)


def test_rebuild_replaces_the_whole_history(spark, db, frame, rows, day):
    schema = "K long, v string, u timestamp_ntz"
    target = f"{db}.dim"
    publish(frame([(1, "A", day(1)), (1, "A", day(2)), (1, "B", day(3))], schema), f"{db}.log")
    assert rebuild_history(spark, f"{db}.log", target, "k", "u", ["v"]) == 2
    assert rows(spark.table(target), "v", "start_dt", "end_dt", "is_active") == [
        ("A", day(1), day(3), False), ("B", day(3), OPEN, True),
    ]
    publish(frame([(1, "C", day(1))], schema), f"{db}.log")
    rebuild_history(spark, f"{db}.log", target, "k", "u", ["v"])
    assert rows(spark.table(target), "v") == [("C",)]
    with pytest.raises(ValueError):
        rebuild_history(spark, f"{db}.log", target, "k", "u", [])
    assert rows(spark.table(target), "v") == [("C",)]


def test_job_log(spark, db, rows):
    table = f"{db}.log_history"
    job = JobLog(spark, table, "DEV_RAW.UTILS.SP", run_id="r1")
    job.start({"a": 1})
    running = read_log(spark, table).first()
    assert (running["status"], running["sp_schema"], running["end_time"]) == ("RUNNING", "UTILS", None)
    job.step("one", "half way")
    assert job.end("SUCCESS", 7, "done")["rows_processed"] == 7
    other = JobLog(spark, table, "DEV_RAW.UTILS.OTHER", run_id="r1")
    other.start()
    other.error("went wrong")
    other.end("FAILED", message="x < y")
    log = read_log(spark, table)
    got = log.select("sp_name", "status", "rows_processed", F.to_json("input_params"))
    assert rows(got) == [("OTHER", "FAILED", 0, "{}"), ("SP", "SUCCESS", 7, '{"a":1}')]
    again = read_log(spark, table).unionByName(spark.table(table))  # ends of one time, one of them twice
    assert rows(settled(again).select("sp_name", "status", "rows_processed")) == [("OTHER", "FAILED", 0), ("SP", "SUCCESS", 7)]
    report = run_report(rows_of_run(log, "r1")).collect()
    assert [r["text"] for r in report if r["line"] == 0] == ["Run failed (1 of 2 models)"]
    assert any("x &lt; y" in r["text"] for r in report)
    with pytest.raises(RuntimeError):
        JobLog(spark, table, "A.B.C").end("SUCCESS")


def test_a_job_goes_on_without_its_log(spark):
    job = JobLog(spark, "no_such_database.log", "DEV_RAW.UTILS.SP")
    job.start()
    assert job.end("SUCCESS")["status"] == "SUCCESS"


def test_stored_view(spark, db, frame, rows):
    publish(frame([(1,), (2,)], "a int"), f"{db}.t")
    store_view(spark, f"{db}.vw", f"SELECT a FROM {db}.t WHERE a > 1")
    assert rows(spark.table(f"{db}.vw")) == [(2,)]
    publish(frame([(3,)], "a int"), f"{db}.t")
    assert rows(spark.table(f"{db}.vw")) == [(3,)]
