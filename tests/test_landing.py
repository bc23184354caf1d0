"""Landing tables are read whole: nothing declared is made up, nothing undeclared is lost."""

from __future__ import annotations

import pytest

from lakemart.sources.landing import landing_schema, read_landing
from lakemart.sources.storage import publish


def test_a_missing_declared_column_fails(spark, db, frame):
    whole = frame([], landing_schema("qb_invoices"))
    publish(whole.drop("load_time"), f"{db}.qb_invoices")
    with pytest.raises(ValueError, match="load_time"):
        read_landing(spark, db, "qb_invoices")


def test_undeclared_columns_come_after_the_declared(spark, db, frame, rows):
    schema = landing_schema("invoice_relation")
    publish(frame([(7, *[None] * len(schema))], f"`Extra x` int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}"), f"{db}.invoice_relation")
    out = read_landing(spark, db, "invoice_relation")
    assert out.columns == [*[f.name.lower() for f in schema], "extra x"] and out.first()["extra x"] == 7


def test_bridge_tables_pass_as_they_come(spark, db, frame, rows):
    publish(frame([(5, 1, "new")], "quote_id int, deal_id long, type string"), f"{db}.assoc_quotes_deals")
    out = read_landing(spark, db, "assoc_quotes_deals")
    assert out.columns == ["quote_id", "deal_id", "type"] and rows(out) == [(5, 1, "new")]
