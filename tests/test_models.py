from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lakemart.plans.daily_load import DailyLoad
from lakemart.plans.models import CONSUMPTION, TRANSFORMS, current_customers
from lakemart.session import work_folder
from lakemart.sources.landing import LANDING, conform, read_landing
from lakemart.sources.storage import newest_partition, publish

OPEN = dt.datetime(9999, 12, 31)

COLUMNS = {"customers": 34, "deals": 21, "parsed_quotes": 14, "qb_invoices": 23, "invoice_relation": 7}


class Landing:
    """Landing tables that rows are added to."""

    def __init__(self, spark):
        self.spark, self.rows = spark, {name: [] for name in LANDING}

    def add(self, table, **values):
        self.rows[table].append({k.lower(): v for k, v in values.items()})

    def __call__(self, table):
        names = [part.split()[0] for part in LANDING[table].replace("(18,2)", "").split(", ")]
        data = [tuple(row.get(n.lower()) for n in names) for row in self.rows[table]]
        return self.spark.createDataFrame(data, LANDING[table])


@pytest.fixture
def landing(spark):
    return Landing(spark)


@pytest.fixture
def loader(spark, landing):
    suffix, place = uuid.uuid4().hex[:10], work_folder(spark, "daily")

    def make(**options):
        return DailyLoad(spark, landing, location=place, suffix=suffix, **options)

    return make


def fill(landing, day):
    stamps = dict(created_at=day(1), updated_at=day(1, 5), load_time=day(1, 6))
    landing.add("customers", id=1, fully_qualified_name="Full", sync_token="0", balance=None, **stamps)
    landing.add("deals", deal_id=1, dealstage="new", amount=None, mdc_quote_id=None, hs_acv=None, **stamps)
    landing.add("deals", deal_id=2, dealstage="new", mdc_quote_id=7, **stamps)
    landing.add("parsed_quotes", quote_id=7, hs_status="DRAFT", **stamps)
    landing.add("qb_invoices", id=5, doc_number="x", **stamps)
    landing.add(
        "invoice_relation", id=1, invoice_id=5, created_at=day(1), updated_at=day(1), transform_ts=day(1, 6)
    )
    landing.add("assoc_quotes_companies", quote_id=7, company_id=3, label="a")
    landing.add("assoc_quotes_companies", quote_id=7, company_id=3, label="a")
    landing.add("assoc_quotes_deals", quote_id=7, deal_id=2, label="a")


def test_every_table_is_declared():
    assert len(TRANSFORMS) == 7 and len(CONSUMPTION) == 8
    assert len(CONSUMPTION["dim_customers"].check_columns) == 31
    assert len(CONSUMPTION["dim_deals"].tracked) == 13 and len(CONSUMPTION["dim_quotes"].tracked) == 8
    assert len(CONSUMPTION["dim_invoices"].columns) == 20 and len(CONSUMPTION["fact_deals"].columns) == 9


@pytest.mark.parametrize("name, n", COLUMNS.items())
def test_transform_columns(landing, name, n):
    assert len(TRANSFORMS[name].clean(landing(name)).columns) == n


def test_customer_cleaning(landing, rows, day):
    landing.add("customers", id=1, company_name=None, fully_qualified_name="Full", created_at=day(1, 9), load_time=day(2, 9))
    landing.add("customers", id=2)
    cleaned = TRANSFORMS["customers"].clean(landing("customers"))
    assert rows(cleaned, "customer_id", "company_name", "bill_addr_city", "sales_term_id", "created_dt", "load_dt") == [
        (1, "Full", "", 0, day(1).date(), day(2).date()),
        (2, "", "", 0, None, None),
    ]


def test_newest_customer_wins(landing, rows, day):
    for token, updated, loaded in (("1", day(1, 3), day(2)), ("2", day(1, 1), day(3))):
        landing.add("customers", id=1, sync_token=token, updated_at=updated, load_time=loaded)
    cleaned = TRANSFORMS["customers"].clean(landing("customers"))
    # both updates fall on one day, so the later load decides
    assert rows(current_customers(cleaned), "customer_id", "sync_token") == [(1, "2")]


def test_two_days(spark, landing, loader, rows, day):
    fill(landing, day)
    first = loader()
    assert set(first.run(day(1, 7)).values()) == {"success"}
    report = first.report().collect()
    assert [(r["report"], r["text"]) for r in report if r["line"] == 0] == [("SUCCESS", "Run succeeded (15 models)")]
    table = lambda name: spark.table(first.table("consumption", name))
    assert rows(table("dim_deals"), "deal_id", "dealstage", "end_dt", "is_active") == [
        (1, "new", OPEN, True), (2, "new", OPEN, True),
    ]
    assert rows(table("fact_deals"), "deal_id", "quote_id") == [(1, None), (2, 7)]
    assert table("dim_assoc_quotes_companies").count() == 1

    late = dict(created_at=day(2), updated_at=day(2, 5), load_time=day(2, 6))
    landing.add("deals", deal_id=2, dealstage="won", mdc_quote_id=7, **late)
    landing.add("deals", deal_id=3, dealstage="skipped", created_at=day(1), updated_at=day(1), load_time=day(1, 23))
    landing.add("customers", id=1, fully_qualified_name="New", sync_token="1", **late)
    loader(run_id="second").run(day(2, 7))
    # the row that landed on an already loaded day stays out
    assert rows(spark.table(first.table("transform", "deals")), "deal_id", "dealstage") == [
        (1, "new"), (2, "new"), (2, "won"),
    ]
    assert rows(table("dim_deals"), "deal_id", "dealstage", "start_dt", "end_dt", "is_active") == [
        (1, "new", day(1, 5), OPEN, True),
        (2, "new", day(1, 5), day(2, 5), False),
        (2, "won", day(2, 5), OPEN, True),
    ]
    # created and loaded stay as first stored; the key with a NULL part came in again
    assert rows(table("fact_deals"), "deal_id", "quote_id", "created_dt", "updated_dt", "load_dt") == [
        (1, None, day(1), day(1, 5), day(1).date()),
        (1, None, day(1), day(1, 5), day(1).date()),
        (2, 7, day(1), day(2, 5), day(1).date()),
    ]
    assert rows(table("dim_customers"), "customer_id", "company_name", "valid_from", "valid_to") == [
        (1, "Full", day(1, 7), day(2, 7)), (1, "New", day(2, 7), OPEN),
    ]
    log = spark.table(first.log_table)
    assert log.count() == 30
    counts = {r["sp_name"]: r["rows_processed"] for r in log.where("job_id LIKE 'second::%'").collect()}
    # true row counts, full rebuilds included
    assert counts["deals"] == 1 and counts["assoc_quotes_companies"] == 2 and counts["dim_deals"] == 3


def test_failed_table_skips_what_is_built_on_it(spark, landing, loader, day):
    fill(landing, day)
    landing.add("assoc_quotes_deals", quote_id=7, deal_id=2, label="other")
    only = {"assoc_quotes_deals", "dim_assoc_quotes_deals", "parsed_quotes", "dim_quotes"}
    loader().run(day(1, 7), only)
    run = loader(run_id="again")
    assert run.run(day(2, 7), only)["dim_assoc_quotes_deals"] == "error"
    report = run.report().collect()
    assert [(r["report"], r["text"]) for r in report if r["line"] == 0] == [("FAILURE", "Run failed (1 of 4 models)")]
    assert any("more than one batch row for key" in r["text"] for r in report)

    broken = loader(run_id="broken")
    broken.landing = lambda name: landing(name).select(F.raise_error(F.lit("<no source>")).alias("quote_id"))
    broken.run(day(3, 7), {"parsed_quotes", "dim_quotes"})
    report = broken.report().collect()
    status = {r["sp_name"]: r["status"] for r in spark.table(broken.log_table).where("job_id LIKE 'broken::%'").collect()}
    assert status == {"parsed_quotes": "FAILED", "dim_quotes": "SKIPPED"}
    assert [r["text"] for r in report if r["line"] == 0] == ["Run failed (1 of 2 models)"]


def test_full_refresh(spark, landing, loader, rows, day):
    fill(landing, day)
    loader().run(day(1, 7), {"deals"})
    landing.add("deals", deal_id=3, dealstage="x", created_at=day(1), updated_at=day(1), load_time=day(1, 23))
    again = loader(full_refresh=True)
    again.run(day(1, 9), {"deals"})
    assert rows(spark.table(again.table("transform", "deals")), "deal_id") == [(1,), (2,), (3,)]


def test_merge_of_new_loads_only(spark, landing, loader, rows, day):
    fill(landing, day)
    only = {"qb_invoices", "dim_invoices"}
    loader().run(day(1, 7), only)
    landing.add("qb_invoices", id=4, doc_number="new", updated_at=day(2), load_time=day(2))
    landing.add("qb_invoices", id=5, doc_number="y", updated_at=day(1, 1), load_time=day(2))
    landing.add("qb_invoices", id=6, doc_number="new", updated_at=day(2), load_time=day(2))
    run = loader(loaded_since=day(2).date())
    run.run(day(2, 7), only)
    # equal days: the later load wins, as over the whole source
    second = [(4, "new"), (5, "y"), (6, "new")]
    assert rows(spark.table(run.table("consumption", "dim_invoices")), "id", "doc_number") == second
    landing.add("qb_invoices", id=6, doc_number="late", updated_at=day(1), load_time=day(3))
    landing.add("qb_invoices", id=4, doc_number="no time", load_time=day(3))
    last = loader(loaded_since=day(3).date())
    last.run(day(3, 7), only)
    assert rows(spark.table(run.table("consumption", "dim_invoices")), "id", "doc_number") == second
    whole = loader(loaded_since=None)
    whole.run(day(4, 7), {"dim_invoices"})
    assert rows(spark.table(run.table("consumption", "dim_invoices")), "id", "doc_number") == second


def test_landing_tables_are_read_as_declared(spark, db, frame, rows):
    publish(frame([(5, "x", 1)], "quote_id int, LABEL string, deal_id long"), f"{db}.assoc_quotes_deals")
    assert rows(read_landing(spark, db, "assoc_quotes_deals")) == [(5, 1, "x")]
    assert conform(frame([(1,)], "Quote_Id int"), "assoc_quotes_deals").dtypes == [
        ("quote_id", "bigint"), ("deal_id", "bigint"), ("label", "string"),
    ]


def test_table_by_day(spark, landing, loader, rows, day, monkeypatch):
    monkeypatch.setitem(TRANSFORMS, "deals", replace(TRANSFORMS["deals"], by_day=True))
    fill(landing, day)
    loader().run(day(1, 7), {"deals"})
    landing.add("deals", deal_id=3, load_time=day(1, 23))
    landing.add("deals", deal_id=4, load_time=day(3, 1))
    run = loader()
    run.run(day(3, 7), {"deals"})
    table = run.table("transform", "deals")
    assert rows(spark.table(table), "deal_id") == [(1,), (2,), (4,)]
    assert newest_partition(spark, table, "load_dt") == day(3).date()
