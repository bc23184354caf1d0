from __future__ import annotations

import datetime as dt

import pytest
from plans_util import physical_plan
from pyspark.sql import functions as F

from lakemart.operators.incremental import EMPTY_TARGET_MARK, high_water, incremental_rows, newer_than
from lakemart.sources.storage import (
    append,
    newest_partition,
    publish,
    publish_history,
    read_current,
    read_current_footers,
    read_open,
    versions,
)
from lakemart.sources.tables import row_counts

LANDED = "id long, load_time timestamp_ntz"


def clean(df):
    return df.select("id", F.col("load_time").alias("load_ts"), F.to_date("load_time").alias("load_dt"))


def test_first_run_takes_everything(frame, rows):
    df = frame([(1, None), (2, dt.datetime(1999, 1, 1))], LANDED)
    assert len(rows(incremental_rows(df, None, "load_time", "load_dt"))) == 2


def test_empty_target_uses_the_default_mark(frame, rows):
    df = frame([(1, None), (2, dt.datetime(2009, 12, 31)), (3, dt.datetime(2010, 1, 1, 8)), (4, dt.datetime(2010, 1, 2))], LANDED)
    empty = clean(df).limit(0)
    assert high_water(empty, "load_dt") == EMPTY_TARGET_MARK
    assert rows(incremental_rows(df, empty, "load_time", "load_dt"), "id") == [(4,)]


def test_rows_without_load_time_never_come_later(frame, rows, day):
    target = clean(frame([(1, day(1))], LANDED))
    df = frame([(2, None), (3, day(2))], LANDED)
    assert rows(incremental_rows(df, target, "load_time", "load_dt"), "id") == [(3,)]


def test_two_batches_one_day(frame, rows, day):
    target = clean(frame([(1, day(1, 9))], LANDED))
    df = frame([(1, day(1, 9)), (2, day(1, 15)), (3, day(2))], LANDED)
    assert rows(incremental_rows(df, target, "load_time", "load_dt"), "id") == [(3,)]
    got = incremental_rows(df, target, "load_time", "load_ts", granularity="timestamp")
    assert rows(got, "id") == [(2,), (3,)]
    with pytest.raises(ValueError):
        newer_than("load_time", day(1), "hour")


def test_mark_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = physical_plan(events.where(newer_than("ts", dt.date(2024, 1, 10))))
    assert "GreaterThanOrEqual(ts,2024-01-11" in plan.replace(" ", "")
    plan = physical_plan(events.where(newer_than("ts", dt.datetime(2024, 1, 10, 5), "timestamp")))
    assert "GreaterThan(ts,2024-01-10T05:00" in plan.replace(" ", "")


def test_daily_batches_equal_one_pass(spark, db, rows):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("event_id").alias("id"), F.col("ts").alias("load_time")
    )
    table = f"{db}.loaded"
    for last in (dt.date(2024, 1, 9), dt.date(2024, 1, 10), dt.date(2024, 1, 20), dt.date(2024, 2, 1)):
        landed = events.where(F.to_date("load_time") <= F.lit(last))
        append(clean(incremental_rows(landed, read_current(spark, table), "load_time", "load_dt")), table)
    assert rows(spark.table(table)) == rows(clean(events))


def test_publish_reads_what_it_replaces(spark, db, frame, rows):
    table = f"{db}.t"
    assert read_current(spark, table) is None
    assert publish(frame([(1,), (2,)], "a int"), table) == 2
    held = read_current(spark, table)
    assert publish(held.union(held).select((F.col("a") + 1).alias("a")), table) == 4
    assert rows(spark.table(table)) == [(2,), (2,), (3,), (3,)]
    assert rows(held) == [(1,), (2,)]
    publish(read_current(spark, table), table)
    assert sorted(versions(spark, table)) == [2, 3]


def test_failed_write_leaves_the_table(spark, db, frame, rows):
    table = f"{db}.t"
    publish(frame([(1,)], "a int"), table)
    broken = read_current(spark, table).select(F.raise_error(F.lit("stop")).cast("int").alias("a"))
    with pytest.raises(Exception, match="stop"):
        publish(broken, table)
    assert rows(spark.table(table)) == [(1,)]
    assert publish(frame([(3,)], "a int"), table) == 1
    assert rows(spark.table(table)) == [(3,)]


def test_append_checks_the_schema(spark, db, frame, rows):
    table = f"{db}.t"
    assert append(frame([(1,)], "a int"), table) == 1
    assert append(frame([(2,)], "a int"), table) == 1
    assert rows(spark.table(table)) == [(1,), (2,)]
    with pytest.raises(ValueError, match="schema"):
        append(frame([("x",)], "a string"), table)


def test_names_that_share_a_prefix(spark, db, frame):
    publish(frame([(1,)], "a int"), f"{db}.t")
    for _ in range(3):
        publish(frame([(1,)], "a int"), f"{db}.t_more")
    assert sorted(versions(spark, f"{db}.t")) == [1]
    assert sorted(versions(spark, f"{db}.t_more")) == [2, 3]


def test_history_table(spark, db, frame, rows):
    table, schema = f"{db}.h", "k long, v string, is_active boolean"
    open_now = F.col("is_active")
    publish_history(frame([(1, "a", True), (2, "a", True)], schema), table, open_now)
    publish_history(frame([(1, "a", False), (1, "b", True), (2, "a", True)], schema), table, open_now)
    held = read_current(spark, table)
    assert rows(read_open(spark, table)) == [(1, "b", True), (2, "a", True)]
    publish_history(frame([(1, "b", False), (1, "c", True), (2, "a", True)], schema), table, open_now)
    third = [(1, "a", False), (1, "b", False), (1, "c", True), (2, "a", True)]
    assert rows(spark.table(table)) == third
    assert rows(held) == [(1, "a", False), (1, "b", True), (2, "a", True)]

    # a run that fails after it has added ended versions is not seen, and its rows go with the next run
    spark.sql(f"INSERT OVERWRITE {table}__ended PARTITION (_version = 4) SELECT 9L, 'lost', false")
    assert rows(spark.table(table)) == third
    publish_history(frame([(1, "c", True), (2, "a", False)], schema), table, open_now)
    assert rows(spark.table(table)) == [(1, "a", False), (1, "b", False), (1, "c", True), (2, "a", False)]

    publish_history(frame([(1, "z", True)], schema), table, open_now, restart=True)
    assert rows(spark.table(table)) == [(1, "z", True)]
    publish_history(frame([(1, "z", False)], schema), table, open_now)
    assert rows(spark.table(table)) == [(1, "z", False)]


def test_newest_partition(spark, db, frame, day):
    table = f"{db}.p"
    schema = "a int, load_dt date"
    publish(frame([(1, None)], schema), table, ("load_dt",))
    assert newest_partition(spark, table, "load_dt") is None
    append(frame([(1, day(3).date()), (2, day(10).date()), (3, day(9).date())], schema), table, ("load_dt",))
    assert newest_partition(spark, table, "load_dt") == day(10).date()


def test_counts_come_from_footers(spark, db, frame, rows, day):
    loaded = clean(frame([(1, day(2)), (2, day(4)), (3, None)], LANDED))
    publish(loaded.repartition(3, "id"), f"{db}.dated")
    publish(loaded.limit(0), f"{db}.nothing")
    publish(loaded.where("load_ts IS NULL"), f"{db}.undated")
    publish(loaded, f"{db}.by_day", ("load_dt",))
    names = ("dated", "nothing", "undated", "by_day")
    counted = row_counts({name: read_current_footers(spark, f"{db}.{name}") for name in names})
    assert physical_plan(counted).count("PushedAggregation: [COUNT(*)]") == len(names)
    assert rows(counted) == [("by_day", 3), ("dated", 3), ("nothing", 0), ("undated", 1)]
    append(clean(frame([(4, day(9))], LANDED)), f"{db}.dated")
    footers = read_current_footers(spark, f"{db}.dated")
    assert rows(row_counts({"dated": footers})) == [("dated", 4)]
    assert rows(footers.where("id > 2"), "id") == [(3,), (4,)]
    # other scans are as before
    assert "BatchScan" not in physical_plan(spark.table(f"{db}.dated").agg(F.count(F.lit(1))))
