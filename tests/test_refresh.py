from __future__ import annotations

import datetime as dt
import re

from lakemart.session import work_folder
from lakemart.sources.storage import publish, versions
from lakemart.streaming.refresh import _read, apply_batch, bucket_of, keep_newest, refresh, stored_buckets, upsert

SCHEMA = "k long, u timestamp_ntz, v string"


def land(frame, folder, rows):
    frame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_refresh_picks_up_where_it_stopped(spark, db, frame, rows, day):
    landing, progress, table = work_folder(spark, "landing"), work_folder(spark, "progress"), f"{db}.fresh"
    land(frame, landing, [(1, day(1), "a"), (1, day(3), "b"), (2, day(1), "c")])
    refresh(stream(spark, landing), table, keep_newest(["k"], "u"), progress).awaitTermination()
    assert rows(spark.table(table), "k", "v") == [(1, "b"), (2, "c")]
    # an older row of key 1 lands late, and two files at once
    land(frame, landing, [(1, day(2), "late"), (3, day(2), "d")])
    land(frame, landing, [(2, day(5), "e")])
    refresh(stream(spark, landing), table, keep_newest(["k"], "u"), progress).awaitTermination()
    assert rows(spark.table(table), "k", "v") == [(1, "b"), (2, "e"), (3, "d")]


def test_a_replayed_batch_changes_nothing(spark, db, frame, rows, day):
    table = f"{db}.fresh"
    merge = upsert(["k"], "u")
    one, two = frame([(1, day(1), "a")], SCHEMA), frame([(1, day(2), "b"), (2, day(2), "c")], SCHEMA)
    publish(merge(None, one), table, number=1)
    for _ in range(2):  # batch 1 is written, its commit is lost, it is run again
        publish(merge(spark.table(versions(spark, table)[1]), two), table, number=2)
        assert rows(spark.table(table), "k", "v") == [(1, "b"), (2, "c")]


def test_upsert_lets_the_later_batch_win(frame, rows, day):
    merge = upsert(["k"], "u")
    state = merge(None, frame([(1, day(9), "a")], SCHEMA))
    assert rows(merge(state, frame([(1, dt.datetime(2024, 1, 1), "b")], SCHEMA)), "v") == [("b",)]


def files(spark, table):
    """Bucket -> its files, of the state that readers see."""
    out = {}
    for path in spark.table(table).inputFiles():
        out.setdefault(re.search(r"_bucket=(\d+)", path).group(1), set()).add(path)
    return out


def test_untouched_buckets_keep_their_files(spark, db, frame, rows, day):
    table, merge = f"{db}.fresh", keep_newest(["k"], "u")
    first = frame([(k, day(1), f"a{k}") for k in range(200)] + [(None, day(1), "none")], SCHEMA)
    assert len(apply_batch(first, table, merge, 0, buckets=16)) == 16
    before = files(spark, table)
    met = apply_batch(frame([(7, day(2), "b"), (300, day(2), "new")], SCHEMA), table, merge, 1, buckets=16)
    after = files(spark, table)
    assert 1 <= len(met) <= 2
    for bucket in before:
        assert (after[bucket] == before[bucket]) == (int(bucket) not in met)
    expected = {**{k: f"a{k}" for k in range(200)}, 7: "b", 300: "new", None: "none"}
    assert {r["k"]: r["v"] for r in spark.table(table).collect()} == expected


def test_replays_late_rows_and_cleaning(spark, db, frame, rows, day):
    table, merge = f"{db}.fresh", keep_newest(["k"], "u")
    batches = [[(1, day(5), "a"), (2, day(1), "b")], [(1, day(3), "late"), (2, day(2), "c")], [], [(None, day(1), "n")], [(2, day(9), "d")]]
    expected = [[(1, "a"), (2, "b")], [(1, "a"), (2, "c")], [(1, "a"), (2, "c")], [(1, "a"), (2, "c"), (None, "n")], [(1, "a"), (2, "d"), (None, "n")]]
    for number, batch in enumerate(batches):
        for _ in range(2):  # the commit of each batch is lost once
            apply_batch(frame(batch, SCHEMA), table, merge, number, buckets=4)
            assert rows(spark.table(table), "k", "v") == expected[number]
    assert max(len(n) for n in stored_buckets(spark, table).values()) <= 2


def test_first_batch_may_be_empty(spark, db, frame, rows, day):
    table, merge = f"{db}.fresh", upsert(["k"], "u")
    assert apply_batch(frame([], SCHEMA), table, merge, 0) == []
    assert rows(spark.table(table)) == [] and spark.table(table).columns == ["k", "u", "v"]
    apply_batch(frame([(1, day(1), "a")], SCHEMA), table, merge, 1)
    assert rows(spark.table(table), "k", "v") == [(1, "a")]


def test_only_met_buckets_are_read(spark, db, frame, day):
    table, merge = f"{db}.fresh", keep_newest(["k"], "u")
    apply_batch(frame([(k, day(1), "a") for k in range(100)], SCHEMA), table, merge, 0, buckets=32)
    number = bucket_of(["k"], 32)
    mine = frame([(5, day(1), "")], SCHEMA).select(number).first()[0]
    read = _read(spark, table, {mine: 0}, spark.table(table))
    assert {re.search(r"_bucket=(\d+)", f).group(1) for f in read.inputFiles()} == {str(mine)}
    seen = spark.table(table).where("true")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in seen and "DataFilters: []" in seen
