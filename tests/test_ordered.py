from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from plans_util import optimized_sizes
from pyspark.sql import functions as F

from lakemart.operators.ordered import (
    PLACED,
    SLICE,
    ordered_rows,
    with_counts,
    with_group_size,
    with_next,
    with_position,
    with_previous,
    with_running_total,
)
from lakemart.plans.history import sequence

SCHEMA = "k long, j string, u timestamp_ntz, i long, v long"


@pytest.fixture(scope="module")
def skewed(spark):
    """Key (NULL, 'x') holds a third of all rows, key (1, 'x') another one; some times are NULL or equal."""
    pick = random.Random(7)
    data = []
    for i in range(600):
        k, j = [(None, "x"), (1, "x"), (pick.randrange(2, 40), "y")][i % 3]
        u = None if pick.random() < 0.05 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=pick.randrange(90))
        data.append((k, j, u, i, pick.randrange(10)))
    return data, spark.createDataFrame(data, SCHEMA).repartition(5)


def brute_force(data):
    out = {}
    for key in {(r[0], r[1]) for r in data}:
        mine = sorted(
            (r for r in data if (r[0], r[1]) == key), key=lambda r: (r[2] is None, r[2] or dt.datetime.min, r[3])
        )
        for n, r in enumerate(mine):
            total = sum(x[4] for x in mine if (x[2] is None, x[2] or dt.datetime.min) <= (r[2] is None, r[2] or dt.datetime.min))
            out[r[3]] = (
                mine[n - 1][4] if n else None,
                mine[n + 1][2] if n + 1 < len(mine) else None,
                total,
                n + 1,
            )
    return out


def found(rows):
    rows = with_position(with_running_total(with_next(with_previous(rows, ["v"])), F.col("v"), "total"), "n")
    return {r["i"]: (r["_prev"]["v"] if r["_prev"] else None, r["_next"], r["total"], r["n"]) for r in rows.result().collect()}


@pytest.mark.parametrize("slices", [None, 1, 7, 64])
def test_against_brute_force(skewed, slices):
    data, df = skewed
    rows = ordered_rows(df, ["k", "j"], "u", ("i",), slices)
    assert found(rows) == brute_force(data)
    assert rows.result().columns == df.columns


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_counts_against_brute_force(skewed, slices):
    data, df = skewed
    expected = {}
    for key in {(r[0], r[1]) for r in data}:
        mine = sorted((r for r in data if (r[0], r[1]) == key), key=lambda r: (r[2] is None, r[2] or dt.datetime.min, r[3]))
        for n, r in enumerate(mine):
            expected[r[3]] = (sum(x[4] > 6 for x in mine[: n + 1]), sum(x[4] > 6 for x in mine), n + 1, len(mine))
    rows = with_counts(ordered_rows(df, ["k", "j"], "u", ("i",), slices), high=F.col("v") > 6, all=F.lit(True)).result()
    assert {r["i"]: (*r["high"], *r["all"]) for r in rows.collect()} == expected


def test_slices_by_date(skewed):
    data, df = skewed
    by_date = [(*r[:2], r[2].date() if r[2] else None, *r[3:]) for r in data]
    rows = ordered_rows(df.withColumn("u", F.to_date("u")), ["k", "j"], "u", ("i",), 30)
    got = found(rows)
    expected = brute_force([(*r[:2], dt.datetime.combine(r[2], dt.time()) if r[2] else None, *r[3:]) for r in by_date])
    for i, (previous, following, total, n) in got.items():
        assert (previous, total, n) == (expected[i][0], *expected[i][2:])
        assert following == (expected[i][1].date() if expected[i][1] else None)


@pytest.mark.parametrize("kind", ["one key", "one key and time", "one key, no time"])
def test_one_key_is_dealt_evenly(spark, kind):
    """Also rows of one key with equal or NULL times, and even rows that are all alike but for the tie-breaker."""
    moment = {"one key": "timestamp_seconds(id)", "one key and time": "timestamp'2024-01-01'", "one key, no time": "CAST(NULL AS timestamp)"}[kind]
    df = spark.range(4000).selectExpr("1L AS k", "'x' AS j", f"CAST({moment} AS timestamp_ntz) AS u", "id AS i", "id % 7 AS v")
    rows = ordered_rows(df, ["k", "j"], "u", ("i",), 20)
    sizes = [r["count"] for r in rows.df.groupBy("_slice").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * 200
    data = [tuple(r) for r in df.collect()]
    mine = sorted(data, key=lambda r: (r[2] or dt.datetime.min, r[3]))
    total = sum(r[4] for r in mine)
    got = found(rows)
    for n, r in enumerate(mine):
        previous, following, running, position = got[r[3]]
        assert position == n + 1 and previous == (mine[n - 1][4] if n else None)
        assert following == (mine[n + 1][2] if n + 1 < len(mine) else None)
        assert running == (sum(x[4] for x in mine[: n + 1]) if kind == "one key" else total)


def test_rows_that_are_all_alike(spark):
    df = spark.range(3000).selectExpr("1L AS k", "'x' AS j", "timestamp_ntz'2024-01-01' AS u", "5L AS i", "1L AS v")
    rows = ordered_rows(df, ["k", "j"], "u", ("i",), 16)
    assert rows.df.groupBy("_slice").count().agg(F.max("count")).first()[0] < 3 * 3000 / 16
    out = with_position(with_running_total(with_previous(rows, ["v"]), F.col("v"), "total"), "n").result().collect()
    assert sorted(r["n"] for r in out) == list(range(1, 3001))
    assert {r["total"] for r in out} == {3000} and sum(r["_prev"] is None for r in out) == 1


def test_empty_and_tiny(spark):
    for n in (0, 1, 2):
        df = spark.range(n).selectExpr("id AS k", "'x' AS j", "CAST(NULL AS timestamp_ntz) AS u", "id AS i", "1L AS v")
        assert len(found(ordered_rows(df, ["k", "j"], "u", ("i",)))) == n
        assert with_group_size(df, "k", "n").count() == n


def test_rows_are_shuffled_once(skewed):
    """By slice; the windows find the rows in place, and what slices hand on is summed up before it is shuffled."""
    _, df = skewed
    rows = with_next(with_previous(ordered_rows(df, ["k", "j"], "u", ("i",), 8), ["v"]))
    plan = rows.result()._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Window") >= 2 and plan.count("shufflepartitionidpassthrough") == 1
    assert "partial_max_by" in plan and "partial_min_by" in plan
    assert "hashpartitioning(k" not in plan and "rangepartitioning" not in plan


def test_a_running_total_sums_the_rows_up_once(skewed):
    """Filtered rows are shuffled again for the sums of other slices: once, whatever is taken from these sums."""
    _, df = skewed
    rows = with_previous(ordered_rows(df, ["k", "j"], "u", ("i",), 8), ["v"]).where(F.col("_prev.v") != F.col("v"))
    plan = with_running_total(rows, F.lit(1), "n").result()._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("shufflepartitionidpassthrough") <= 2


def test_zoned_times(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "'x' AS j", "timestamp_seconds(1711846800 + id * 30) AS u", "id AS i", "id AS v")
    out = with_previous(ordered_rows(df, ["k", "j"], "u", ("i",), 12), ["v"]).result()
    assert out.where("k = 1 AND v > 3 AND _prev.v != v - 3").count() == 0


def test_group_size(skewed):
    data, df = skewed
    sizes = Counter((r[0], r[1]) for r in data)
    got = with_group_size(df, ["k", "j"], "n").collect()
    assert len(got) == len(data)
    assert all(r["n"] == sizes[(r["k"], r["j"])] for r in got)
    again = with_group_size(df.select("k", "j").union(df.select("k", "j")), ["k", "j"], "n").collect()
    assert all(r["n"] == 2 * sizes[(r["k"], r["j"])] for r in again)


def test_a_sequence_takes_no_larger_plan_for_more_slices(spark, tmp_path):
    """Cuts are a row, not constants in every step; Spark follows a join's key back to the slices, not through all steps."""
    spark.range(300).selectExpr(
        "id AS event_id", "CAST(timestamp_seconds(id DIV 2) AS timestamp_ntz) AS ts", "id % 5 AS user_id",
        "CAST(id % 3 AS string) AS event_type", "CAST(id AS double) AS value", "'{}' AS props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def build(slices):
        spark.conf.set("spark.sql.shuffle.partitions", str(slices))
        return sequence(spark, str(tmp_path))

    try:
        few, many = optimized_sizes(build)
        assert many < 2 * few
        rows = build(200).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r["event_id"], r["place"]) for r in rows] == [(i, i + 1) for i in range(300)]
    assert [int(r["so_far"]) for r in rows] == [sum(range(2 * (i // 2) + 2)) for i in range(300)]
    assert [r["type_before"] for r in rows] == [None, *[str(i % 3) for i in range(299)]]


@pytest.mark.parametrize("n_keys", [1, 300])
def test_summaries_place_rows_of_cut_keys_only(spark, n_keys):
    """Before, every row was placed a second time for the summaries."""
    df = spark.range(3000, numPartitions=3).select((F.col("id") % n_keys).alias("k"), F.lit(1).alias("t"), "id")
    rows = ordered_rows(df, "k", "t", slices=4)
    flat = {r.id: (r[SLICE], r[PLACED]) for r in rows.flat.collect()}
    dealt = {r.id: (r[SLICE], r[PLACED], r.k) for r in rows.df.collect()}
    edges = {i for i, (_, placed, _) in dealt.items() if placed.run is not None}
    assert edges <= set(flat)
    assert len({dealt[i][2] for i in flat}) <= 3
    assert all(flat[i] == dealt[i][:2] for i in flat)  # rows of one place are dealt alike in both
    positions = with_position(rows, "p").result().collect()
    assert sorted((r.k, r.p) for r in positions) == [(k, p) for k in range(n_keys) for p in range(1, 3000 // n_keys + 1)]
