from __future__ import annotations

import datetime as dt

import pytest
from plans_util import optimized_sizes
from pyspark.sql import functions as F

from lakemart.operators.report import _failure_entry, failure_report, run_report, success_report
from lakemart.operators.runlog import (
    LOG_COLUMNS,
    log_end,
    log_rows,
    log_start,
    report_choice,
    rows_of_run,
    run_failures,
    run_summary,
)

RESULTS = (
    "run_id string, node string, name string, database string, schema string, "
    "status string, duration double, rows long, message string"
)
CLOCK = dt.datetime(2024, 1, 1, 12)
LONG = "<&>" * 700


@pytest.fixture
def log(frame):
    return log_rows(
        frame(
            [
                ("good", "a", "a", "db", "s", "success", 1.256, 10, None),
                ("good", "b", None, "db", None, "skipped", None, None, None),
                ("bad", "a", "a", "db", "s", "error", 90.4, 0, LONG),
                ("bad", "b", "b", "db", "s", "pass", 2.0, 5, "fine $$"),
                ("bad", "c", "c", None, None, "fail", 91.0, None, None),
                ("idle", "a", "a", "db", "s", "skipped", 0.0, 0, ""),
            ],
            RESULTS,
        ),
        CLOCK,
        "me",
    )


def test_log_rows(log):
    assert log.columns == list(LOG_COLUMNS)
    rows = {r["job_id"]: r for r in log.collect()}
    assert rows["bad::a"]["status"] == "FAILED" and rows["bad::a"]["start_time"] == CLOCK - dt.timedelta(seconds=90)
    assert rows["bad::c"]["start_time"] == CLOCK - dt.timedelta(seconds=91)
    assert rows["good::b"]["duration_seconds"] == 0 and rows["good::b"]["rows_processed"] == 0
    assert rows["bad::b"]["message"] == "fine " and rows["good::a"]["message"] == ""
    assert rows["good::a"]["end_time"] == CLOCK and rows["good::a"]["executed_by"] == "me"


def test_summary(log):
    got = {r["run_id"]: r for r in run_summary(log).collect()}
    assert (got["good"]["total"], got["good"]["failed"], got["good"]["rows_processed"]) == (2, 0, 10)
    assert (got["bad"]["total"], got["bad"]["failed"]) == (3, 2)
    assert got["bad"]["started"] == CLOCK - dt.timedelta(seconds=91)
    assert float(got["good"]["duration_seconds"]) == 1.256


def test_rows_of_run_and_failures(log, frame):
    assert rows_of_run(log, "good").count() == 2
    assert rows_of_run(log, "goo").count() == 0
    assert sorted(r["job_id"] for r in run_failures(log).collect()) == ["bad::a", "bad::c"]


def test_one_report_per_run(log):
    assert {r["run_id"]: r["report"] for r in report_choice(log).collect()} == {
        "good": "SUCCESS", "bad": "FAILURE", "idle": "SUCCESS",
    }
    reports = run_report(log).collect()
    assert {(r["run_id"], r["report"]) for r in reports} == {
        ("bad", "FAILURE"), ("good", "SUCCESS"), ("idle", "SUCCESS"),
    }
    assert texts(reports, "bad") == texts(failure_report(log).collect(), "bad")
    assert texts(reports, "good") == texts(success_report(log).collect(), "good")
    assert run_report(rows_of_run(log, "none")).count() == 0


def texts(lines, run):
    """The texts of a report in order; line numbers must run from 0 without a gap."""
    mine = sorted((r["line"], r["text"]) for r in lines if r["run_id"] == run)
    assert [n for n, _ in mine] == list(range(len(mine)))
    return [text for _, text in mine]


def test_success_text(log):
    lines = texts(success_report(log).collect(), "good")
    assert lines[0] == "Run succeeded (2 models)"
    assert "<p>Total rows: 10</p>" in lines and "<p>Total seconds: 1.26</p>" in lines
    # the longest node started first
    assert lines[-3:] == [
        "<tr><td>a</td><td>db.s</td><td>SUCCESS</td><td>10</td><td>1.26</td></tr>",
        "<tr><td>?</td><td>db.</td><td>SKIPPED</td><td>0</td><td>0.00</td></tr>",
        "</table>",
    ]


@pytest.mark.parametrize("length", [None, 1500])
def test_failure_text(log, length):
    report = failure_report(log, message_length=length).collect()
    assert {r["run_id"] for r in report} == {"bad"}
    lines = texts(report, "bad")
    assert lines[0] == "Run failed (2 of 3 models)"
    escaped = ("&lt;&amp;&gt;" * 700)[:length]
    assert lines[-2:] == ["<div><b>c</b> . 91.00s<pre></pre></div>", f"<div><b>a</b> db.s 90.40s<pre>{escaped}</pre></div>"]


def test_missing_message(log):
    broken = log.where("job_id = 'bad::a'").withColumn("message", F.lit(None).cast("string"))
    assert "No error message recorded." in texts(failure_report(broken).collect(), "bad")[-1]


@pytest.mark.parametrize("length", [1, 4, 5, 8, 9])
def test_a_cut_message_is_escaped_as_far_as_it_is_kept(log, length):
    kept = "&lt;&amp;&gt;"[:length]
    assert f"<pre>{kept}</pre>" in texts(failure_report(log, message_length=length).collect(), "bad")[-1]
    assert "left(coalesce(message" in str(_failure_entry(length))


def test_a_report_joins_no_runs(log):
    """All rows of a large run would be in one task of that join."""
    plan = run_report(log)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Join Cross" in plan


def test_nodes_without_status_count_as_not_failed(log):
    odd = log.withColumn("status", F.when(~F.col("job_id").isin("good::b", "bad::b"), F.col("status")))
    reports = run_report(odd).collect()
    assert "<tr><td>?</td><td>db.</td><td></td><td>0</td><td>0.00</td></tr>" in texts(reports, "good")
    assert len(texts(reports, "bad")) == 7


@pytest.mark.parametrize("slices", [None, 100])
def test_a_large_run_is_one_report(frame, slices):
    results = [("r", f"n{i:04d}", f"n{i:04d}", "db", "s", "error", float(i % 20), 0, "x") for i in range(2500)]
    log = log_rows(frame(results, RESULTS), CLOCK, "me")
    lines = texts(failure_report(log, slices=slices).collect(), "r")
    assert lines == texts(run_report(log, slices=slices).collect(), "r")
    assert len(lines) == 2505 and lines[0] == "Run failed (2500 of 2500 models)"
    # the longest first, then by job
    expected = sorted(results, key=lambda r: (-r[6], r[1]))
    assert [line[8:13] for line in lines[5:]] == [r[2] for r in expected]


def test_start_and_end(frame, rows):
    jobs = frame(
        [("r", "a", "DEV_RAW.UTILS.SP", '{"k": 1}'), ("r", "b", "SP", "{broken"), ("r", "c", "A.B", None)],
        "run_id string, node string, qualified_name string, input_params string",
    )
    log = log_start(jobs, CLOCK, "me")
    endings = frame(
        [("r::a", CLOCK, 1.5, "SUCCESS", 7, "done"), ("unknown", CLOCK, 1.5, "SUCCESS", 7, "done")],
        "job_id string, end_time timestamp_ntz, duration_seconds double, status string, rows_processed long, message string",
    )
    ended = log_end(log, endings).withColumn("params", F.to_json("input_params"))
    got = rows(ended, "job_id", "sp_database", "sp_schema", "sp_name", "status", "rows_processed", "params")
    assert got == [
        ("r::a", "DEV_RAW", "UTILS", "SP", "SUCCESS", 7, '{"k":1}'),
        ("r::b", "SP", "", "SP", "RUNNING", None, None),
        ("r::c", "A", "B", "B", "RUNNING", None, "{}"),
    ]


@pytest.mark.parametrize("report", [failure_report, run_report, success_report])
def test_a_report_takes_no_larger_plan_for_more_slices(log, report):
    few, many = optimized_sizes(lambda slices: report(log, slices=slices))
    assert many < 2 * few


def test_the_report_of_a_single_run_takes_no_larger_plan_for_more_slices(log):
    one = log.withColumn("job_id", F.concat(F.lit("all::"), "job_id"))
    few, many = optimized_sizes(lambda slices: run_report(one, slices=slices))
    assert many < 2 * few
