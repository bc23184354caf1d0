from __future__ import annotations

import datetime as dt
import re
from itertools import pairwise

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from plans_util import count_node, optimized_sizes, physical_plan
from pyspark.sql import functions as F

from lakemart.operators.scd2 import (
    change_streak,
    scd2_close,
    scd2_incremental,
    scd2_new_versions,
    scd2_rebuild,
    scd2_seed,
)
from lakemart.operators.snapshot import snapshot_check

SCHEMA = "k long, v string, u timestamp_ntz, p long"
OPEN = dt.datetime(9999, 12, 31)
PLAN = {"key": "k", "updated": "u", "tracked": ["v"]}


@pytest.fixture
def load(frame, rows):
    """Runs of a growing source; the state after the last run."""

    def run(batches, scope):
        state, seen = None, []
        for batch in batches:
            seen = seen + batch
            source = frame(seen, SCHEMA)
            if state is None:
                state = scd2_seed(source, passthrough=("p",), **PLAN)
            else:
                state = scd2_incremental(state, source, passthrough=("p",), match_scope=scope, **PLAN)
            state = frame(state.collect(), state.schema)
        return rows(state, "k", "v", "start_dt", "end_dt", "is_active")

    return run


def test_aba(load, day):
    runs = [[(1, "A", day(1), 0)], [(1, "B", day(2), 0)], [(1, "A", day(3), 0)]]
    assert load(runs, "any") == [
        (1, "A", day(1), day(2), False),
        (1, "B", day(2), day(3), False),
    ]
    assert load(runs, "active") == [
        (1, "A", day(1), day(2), False),
        (1, "A", day(3), OPEN, True),
        (1, "B", day(2), day(3), False),
    ]


def test_late_versions(load, day):
    first = [(1, "A", day(1), 0), (1, "B", day(2), 0), (1, "C", day(3), 0)]
    assert load([first], "any") == [(1, "C", day(3), OPEN, True)]
    assert load([first, []], "any") == [(1, "B", day(2), OPEN, True), (1, "C", day(3), OPEN, True)]
    assert load([first, [], []], "any") == [
        (1, "A", day(1), OPEN, True), (1, "B", day(2), day(3), False), (1, "C", day(3), OPEN, True),
    ]
    assert load([first, [], [], []], "any") == [
        (1, "A", day(1), day(3), False), (1, "B", day(2), day(3), False), (1, "C", day(3), OPEN, True),
    ]
    assert load([first, [], [], []], "active") == [(1, "C", day(3), OPEN, True)]


def test_null_is_a_value(load, day):
    runs = [[(1, None, day(1), 0)], [(1, None, day(2), 0)], [(1, "A", day(3), 0)]]
    for scope in ("any", "active"):
        assert load(runs, scope) == [(1, "A", day(3), OPEN, True), (1, None, day(1), day(3), False)]


def test_passthrough_opens_no_version(load, day):
    runs = [[(1, "A", day(1), 5)], [(1, "A", day(2), 6)]]
    for scope in ("any", "active"):
        assert load(runs, scope) == [(1, "A", day(1), OPEN, True)]


def test_new_keys_come_in(load, day):
    runs = [[(1, "A", day(1), 0)], [(2, "A", day(2), 0)]]
    for scope in ("any", "active"):
        assert load(runs, scope) == [(1, "A", day(1), OPEN, True), (2, "A", day(2), OPEN, True)]


def test_close_leaves_closed_rows_alone(frame, rows, day):
    target = frame(
        [(1, "A", day(1), day(2), False), (1, "B", day(2), OPEN, True), (2, "A", day(1), OPEN, True)],
        "k long, v string, start_dt timestamp_ntz, end_dt timestamp_ntz, is_active boolean",
    )
    source = frame([(1, "C", day(4), 0), (1, "X", day(3), 0)], SCHEMA)
    assert rows(scd2_close(target, source, **PLAN)) == [
        (1, "A", day(1), day(2), False), (1, "B", day(2), day(4), False), (2, "A", day(1), OPEN, True),
    ]


def test_end_takes_the_type_of_the_update_column(frame):
    df = frame([(1, "A", dt.date(2024, 1, 1))], "k long, v string, u date")
    row = scd2_seed(df, **PLAN).first()
    assert row["end_dt"] == dt.date(9999, 12, 31) and row["start_dt"] == dt.date(2024, 1, 1)


def test_match_scope_is_checked(frame):
    df = frame([], SCHEMA)
    with pytest.raises(ValueError, match="match_scope"):
        scd2_new_versions(scd2_seed(df, **PLAN), df, match_scope="all", **PLAN)


def test_all_null_first(frame, rows, day):
    df = frame([(1, None, day(1), 0), (1, "A", day(2), 0), (2, None, day(1), 0)], SCHEMA)
    assert rows(scd2_rebuild(df, **PLAN), "k", "v", "start_dt") == [(1, "A", day(2))]
    assert len(rows(scd2_rebuild(df, keep_first=True, **PLAN))) == 3


def test_rebuild_needs_tracked_columns(frame):
    with pytest.raises(ValueError, match="tracked"):
        scd2_rebuild(frame([], SCHEMA), "k", "u", [])


def test_rebuild_columns(frame):
    df = frame([], SCHEMA)
    assert scd2_rebuild(df, created="p", **PLAN).columns == ["k", "v", "p", "u", "start_dt", "end_dt", "is_active"]
    assert scd2_rebuild(df, **PLAN).columns == ["k", "v", "u", "start_dt", "end_dt", "is_active"]


def test_null_times_come_last(frame, rows, day):
    df = frame([(1, "A", day(1), 0), (1, "B", None, 0)], SCHEMA)
    assert rows(scd2_rebuild(df, **PLAN), "v", "start_dt", "is_active") == [("A", day(1), True), ("B", None, True)]


def test_rebuild_is_one_shuffle(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = scd2_rebuild(events, "user_id", "ts", ["event_type"], ties=("event_id",))
    df.collect()
    plan = physical_plan(df).split("Initial Plan")[0]
    # rows by slice, once; what the slices' edges hand on is summed up in the tasks before it is shuffled
    assert len(re.findall(r"\+- Exchange shufflepartitionidpassthrough", plan)) == 1
    assert "partial_max_by" in plan and "partial_min_by" in plan and "rangepartitioning" not in plan


def test_active_scope_joins_on_the_key_alone(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = {"key": "user_id", "updated": "ts", "tracked": ["event_type"], "ties": ("event_id",)}
    target = frame_of(scd2_seed(events, **plan))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        added = scd2_new_versions(target, events, match_scope="active", **plan)
        # the source by key, the open slice by key, no further shuffle for the anti join
        assert count_node(added, "Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def frame_of(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_several_open_versions_of_a_key(frame, rows, day):
    """As a table looks that was loaded with "any" before."""
    schema = "k long, v string, start_dt timestamp_ntz, end_dt timestamp_ntz, is_active boolean"
    target = frame(
        [
            (1, "A", day(1), OPEN, True), (1, "B", day(2), OPEN, True), (1, "Z", day(1), day(2), False),
            (2, "A", day(1), OPEN, True), (2, "B", day(2), OPEN, True),
            (3, None, day(1), OPEN, True), (None, "N", day(1), OPEN, True), (4, "gone", day(1), OPEN, True),
        ],
        schema,
    )
    source = frame([(1, "B", day(5), 0), (2, "C", day(5), 0), (3, None, day(5), 0), (None, "N", day(5), 0)], SCHEMA)
    assert rows(scd2_incremental(target, source, match_scope="active", **PLAN)) == [
        (1, "A", day(1), day(5), False), (1, "B", day(2), OPEN, True), (1, "Z", day(1), day(2), False),
        (2, "A", day(1), day(5), False), (2, "B", day(2), day(5), False), (2, "C", day(5), OPEN, True),
        (3, None, day(1), OPEN, True), (4, "gone", day(1), OPEN, True),
        (None, "N", day(1), OPEN, True), (None, "N", day(5), OPEN, True),
    ]


def test_streak_shares_ties(frame, rows, day):
    df = frame([(1, "A", day(1), 0), (1, "B", day(2), 0), (1, "C", day(2), 1), (1, "C", day(3), 0)], SCHEMA)
    got = rows(change_streak(df, "k", "u", ["v"], ("p",)), "v", "streak")
    assert got == [("A", 1), ("B", 3), ("C", 3)]


def expected_rebuild(log, keep_first=False):
    out = []
    for key in sorted({r[0] for r in log}):
        mine = sorted((r for r in log if r[0] == key), key=lambda r: (r[2], r[3]))
        kept, last, first = [], None, True
        for r in mine:
            if r[1] != last or (keep_first and first):
                kept.append(r)
            last, first = r[1], False
        for i, r in enumerate(kept):
            following = kept[i + 1][2] if i + 1 < len(kept) else None
            out.append((key, r[1], r[2], following or OPEN, following is None))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


# one key holds most rows; times repeat; values are few so that changes and repeats mix
LOG = st.lists(
    st.tuples(st.sampled_from([1, 1, 1, 1, 2, 3]), st.sampled_from(["A", "B", None]), st.integers(1, 12)),
    max_size=60,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(LOG)
def test_rebuild_with_and_without_hot_keys(frame, rows, log):
    log = [(k, v, dt.datetime(2024, 1, u), i) for i, (k, v, u) in enumerate(log)]
    df = frame(log, SCHEMA)
    columns = ("k", "v", "start_dt", "end_dt", "is_active")
    for slices in (None, 40):
        got = rows(scd2_rebuild(df, ties=("p",), slices=slices, **PLAN), *columns)
        assert got == expected_rebuild(log)
    got = rows(scd2_rebuild(df, ties=("p",), keep_first=True, slices=40, **PLAN), *columns)
    assert got == expected_rebuild(log, keep_first=True)


def test_versions_chain(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn(
        "kind", F.nullif("event_type", F.lit("error"))
    )
    built = scd2_rebuild(events, "user_id", "ts", ["kind"], ties=("event_id",)).collect()
    for user in {r["user_id"] for r in built}:
        mine = sorted((r for r in built if r["user_id"] == user), key=lambda r: r["start_dt"])
        assert [r["is_active"] for r in mine] == [False] * (len(mine) - 1) + [True]
        for left, right in pairwise(mine):
            assert left["end_dt"] == right["start_dt"] and left["kind"] != right["kind"]


def test_one_open_version_per_key(load, day):
    runs = [
        [(k, "ABC"[(k + n) % 3], day(1 + n), 0) for k in range(6) if (k + n) % 4]
        for n in range(4)
    ]
    got = load(runs, "active")
    seen = {r[0] for batch in runs for r in batch}
    assert sorted(r[0] for r in got if r[4]) == sorted(seen)


CUSTOMER = "c long, name string, load_dt long"


def test_snapshot(frame, rows, day):
    check = ["name"]
    first = snapshot_check(None, frame([(1, "A", 1), (2, "A", 1), (3, None, 1)], CUSTOMER), "c", check, day(1))
    batch = frame([(1, "B", 2), (2, "A", 2), (4, "N", 2)], CUSTOMER)
    second = snapshot_check(first, batch, "c", check, day(2))
    assert rows(second, "c", "name", "load_dt", "valid_from", "valid_to") == [
        (1, "A", 1, day(1), day(2)),
        (1, "B", 2, day(2), OPEN),
        (2, "A", 1, day(1), OPEN),
        (3, None, 1, day(1), OPEN),
        (4, "N", 2, day(2), OPEN),
    ]
    again = snapshot_check(second, batch, "c", check, day(3))
    assert rows(again) == rows(second)
    back = snapshot_check(second, frame([(1, "A", 3)], CUSTOMER), "c", check, day(4))
    assert rows(back.where("c = 1"), "name", "valid_from", "valid_to") == [
        ("A", day(1), day(2)), ("A", day(4), OPEN), ("B", day(2), day(4)),
    ]
    ids = [r["version_id"] for r in back.collect()]
    assert len(set(ids)) == len(ids)


def test_streak_takes_no_larger_plan_for_more_slices(spark):
    df = spark.range(300).selectExpr("id % 3 AS k", "CAST(timestamp_seconds(id) AS timestamp_ntz) AS u", "id DIV 9 AS v", "id AS p")
    few, many = optimized_sizes(lambda slices: change_streak(df, "k", "u", ["v"], ("p",), slices=slices))
    assert many < 2 * few
