from __future__ import annotations

import pytest
from plans_util import count_node, physical_plan
from pyspark.sql import functions as F

from lakemart.operators.dedupe import distinct_rows, latest_per_key
from lakemart.operators.merge import append_all, merge_distinct, merge_latest, merge_newer, merge_state, unique_batch

KV = "k long, q long, v string"


def test_same_day_tie(frame, rows, day):
    df = frame([(1, day(1), 7), (1, day(1), 9), (2, day(1), 1)], "k long, u timestamp_ntz, id long")
    assert rows(latest_per_key(df, "k", "u", ("id",)), "k", "id") == [(1, 9), (2, 1)]


def test_null_update_time(frame, rows, day):
    df = frame([(1, None, 7), (1, day(1), 9)], "k long, u timestamp_ntz, id long")
    assert rows(latest_per_key(df, "k", "u"), "id") == [(9,)]
    assert rows(latest_per_key(df, "k", "u", nulls="first"), "id") == [(7,)]


def test_null_keys_form_one_group(frame, rows, day):
    df = frame([(None, day(1), 7), (None, day(2), 9)], "k long, u timestamp_ntz, id long")
    assert rows(latest_per_key(df, "k", "u"), "id") == [(9,)]


def test_rank_is_limited_before_the_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = physical_plan(latest_per_key(df, "o_custkey", "o_orderdate", ("o_orderkey",)))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("WindowGroupLimit", plan.index("Exchange")) > 0


def test_distinct(frame, rows):
    df = frame([(1, None, "a"), (1, None, "a"), (1, 2, "a")], KV)
    assert len(rows(distinct_rows(df))) == 2


def test_upsert(frame, rows):
    target = frame([(1, 1, "old"), (2, 1, "keep")], KV)
    batch = frame([(1, 1, "new"), (3, 1, "in")], KV)
    expected = [(1, 1, "new"), (2, 1, "keep"), (3, 1, "in")]
    merged = merge_state(target, batch, ["k", "q"])
    assert rows(merged) == expected
    assert rows(merge_state(merged, batch, ["k", "q"])) == expected


def test_null_key_merge(frame, rows):
    batch = frame([(1, None, "a")], KV)
    plain = merge_state(batch, batch, ["k", "q"])
    assert rows(plain) == [(1, None, "a")] * 2
    assert rows(merge_state(plain, batch, ["k", "q"])) == [(1, None, "a")] * 3
    assert rows(merge_state(batch, batch, ["k", "q"], null_safe_keys=True)) == [(1, None, "a")]


def test_partial_update(frame, rows):
    schema = "k long, q long, amount long, created string"
    target = frame([(1, 1, 10, "first"), (2, 1, 20, "first"), (4, None, 40, "first")], schema)
    batch = frame([(1, 1, 11, "second"), (3, 1, 30, "second"), (4, None, 41, "second")], schema)
    merged = merge_state(target, batch, ["k", "q"], ["amount"])
    assert rows(merged) == [
        (1, 1, 11, "first"), (2, 1, 20, "first"), (3, 1, 30, "second"), (4, None, 40, "first"), (4, None, 41, "second"),
    ]
    safe = merge_state(target, batch, ["k", "q"], ["amount"], null_safe_keys=True)
    assert (4, None, 41, "first") in rows(safe) and len(rows(safe)) == 4


def test_partial_update_to_null(frame, rows):
    target = frame([(1, 1, "a")], KV)
    assert rows(merge_state(target, frame([(1, 1, None)], KV), ["k", "q"], ["v"])) == [(1, 1, None)]


def test_update_without_insert(frame, rows):
    target = frame([(1, 1, "a")], KV)
    batch = frame([(1, 1, "b"), (2, 1, "c")], KV)
    assert rows(merge_state(target, batch, ["k", "q"], insert_new=False)) == [(1, 1, "b")]


def test_duplicate_batch_key_fails(frame, rows):
    batch = frame([(1, 2, "x"), (1, 2, "y"), (1, 2, "x")], KV)
    with pytest.raises(Exception, match="more than one batch row"):
        merge_distinct(batch.limit(0), batch, ["k", "q"]).collect()
    once = frame([(1, 2, "x"), (1, 2, "x"), (2, None, "z")], KV)
    assert rows(merge_distinct(once.limit(0), once, ["k", "q"])) == [(1, 2, "x"), (2, None, "z")]
    assert rows(unique_batch(once.distinct(), ["k", "q"])) == [(1, 2, "x"), (2, None, "z")]


def test_merge_latest_picks_columns(frame, rows, day):
    source = frame([(1, day(1), "a", 1), (1, day(2), "b", 2)], "k long, u timestamp_ntz, v string, other int")
    target = frame([(1, "z"), (5, "y")], "k long, v string")
    merged = merge_latest(target, source, ["k"], "u", columns=["k", "v"])
    assert rows(merged) == [(1, "b"), (5, "y")]


def test_merge_needs_equal_columns(frame):
    with pytest.raises(ValueError, match="columns differ"):
        merge_state(frame([(1,)], "a int"), frame([(1,)], "b int"), ["a"])


def test_append_without_key(frame, rows):
    df = frame([(1, 1, "a")], KV)
    assert rows(append_all(df, df)) == [(1, 1, "a")] * 2


def test_small_batch_leaves_the_target_unshuffled(spark):
    target = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    batch = target.where("o_orderkey = 1")
    for updates in (None, ["o_totalprice"]):
        merged = merge_state(target, batch, ["o_orderkey"], updates)
        assert count_node(merged, "Exchange hashpartitioning") == 0
        assert "BroadcastHashJoin" in physical_plan(merged)


def test_large_merge_shuffles_the_target_once(spark):
    target = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    batch = target.withColumn("l_tax", F.lit(0.0))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge_state(target, batch, ["l_orderkey"])
        assert count_node(merged, "Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_newer_rows_replace(frame, rows, day):
    schema = "k long, u timestamp_ntz, i long, v string"
    target = frame(
        [(1, day(2), 1, "t"), (2, day(2), 1, "t"), (3, None, 1, "t"), (4, day(2), 1, "t"), (6, day(1), 1, "t")]
        + [(None, day(1), 1, "t")],
        schema,
    )
    batch = frame(
        [(1, day(3), 1, "s"), (2, day(1), 9, "s"), (3, day(1), 0, "s"), (4, day(2), 2, "s"), (5, None, 1, "s")]
        + [(6, None, 9, "s"), (None, day(2), 1, "s")],
        schema,
    )
    merged = merge_newer(target, batch, ["k"], "u", ("i",))
    assert rows(merged, "k", "v") == [(1, "s"), (2, "t"), (3, "s"), (4, "s"), (5, "s"), (6, "t"), (None, "s")]
