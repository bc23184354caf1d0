from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakemart.functions.clean import as_date, blank_if_null, first_present, zero_if_null
from lakemart.functions.compare import all_same, any_changed
from lakemart.functions.text import (
    belongs_to_run,
    clip,
    escape_html,
    job_id,
    log_message,
    log_status,
    run_of,
    split_name,
)
from lakemart.sources.layers import database, log_database


def one(frame, value, expression, kind="string"):
    return frame([(value,)], f"v {kind}").select(expression.alias("x")).first()["x"]


def test_null_replacement(frame):
    assert one(frame, None, blank_if_null("v")) == ""
    assert one(frame, "a", blank_if_null("v")) == "a"
    assert one(frame, None, zero_if_null("v"), "long") == 0
    assert one(frame, None, first_present("v", F.lit(None))) == ""
    assert one(frame, None, first_present("v", F.lit("b"))) == "b"


def test_date(frame, day):
    assert one(frame, day(3, 23), as_date("v"), "timestamp_ntz") == day(3).date()


def test_null_safe_comparison(frame):
    df = frame([(None, None, 1, 1), (None, 1, 1, 1), (1, 1, 1, 2)], "a int, b int, c int, d int")
    pairs = [(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))]
    got = [tuple(r) for r in df.select(any_changed(pairs), all_same(pairs)).collect()]
    assert got == [(False, True), (True, False), (True, False)]


def test_escape_before_cut(frame):
    text = "&<" * 1000
    got = one(frame, text, clip(escape_html("v"), 1500))
    assert got == ("&amp;&lt;" * 1000)[:1500]
    assert one(frame, "a<b>&amp;", escape_html("v")) == "a&lt;b&gt;&amp;amp;"


@pytest.mark.parametrize(
    "given, expected",
    [("error", "FAILED"), ("fail", "FAILED"), ("success", "SUCCESS"), ("pass", "SUCCESS"),
     ("skipped", "SKIPPED"), ("warn", "WARN"), ("partial success", "PARTIAL SUCCESS")],
)
def test_status(frame, given, expected):
    assert one(frame, given, log_status("v")) == expected


def test_message(frame):
    assert one(frame, "a $$b$$", log_message("v")) == "a b"
    assert one(frame, None, log_message("v")) == ""


def test_job_ids(frame):
    assert one(frame, "run", job_id("v", F.lit("node"))) == "run::node"
    assert one(frame, "run::node", run_of("v")) == "run"
    assert one(frame, "bare", run_of("v")) is None
    assert one(frame, "r_n::x", belongs_to_run("v", "r_n"))
    assert not one(frame, "run::x", belongs_to_run("v", "r_n"))
    assert not one(frame, "run2::x", belongs_to_run("v", "run"))


@pytest.mark.parametrize(
    "given, expected",
    [("A.B.C", ("A", "B", "C")), ("A.B", ("A", "B", "B")), ("A", ("A", "", "A")), ("A.B.C.D", ("A", "B", "D"))],
)
def test_split_name(frame, given, expected):
    parts = split_name("v")
    row = frame([(given,)], "v string").select(
        parts["sp_database"], parts["sp_schema"], parts["sp_name"]
    ).first()
    assert tuple(row) == expected


def test_names():
    assert database("DEV", "RAW") == "dev_raw"
    assert database("prod", "consumption", "analytics") == "prod_consumption_analytics"
    assert log_database("PROD_CONSUMPTION.ANALYTICS.SP") == "prod_raw"
    assert log_database("TEST_CONSUMPTION.ANALYTICS.SP") == "dev_raw"
    assert log_database("SP", configured="dev_raw") == "dev_raw"
    with pytest.raises(ValueError):
        log_database("SP")
    with pytest.raises(ValueError):
        database("dev", "other")
