"""A table kept fresh from a stream of landing files.

The state lies in hash buckets of the key, one folder per bucket and batch that changed
it. A micro-batch reads and writes only the buckets its keys fall into; the files of all
others stay. The published name is a view of the newest folder of every bucket, switched
in one catalog step. State ``n`` is always built from the folders of batches before
``n``, so a replayed batch writes the same folders again and no row counts twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakemart.operators.dedupe import latest_per_key
from lakemart.operators.merge import merge_newer, merge_state
from lakemart.sources.storage import exists

BUCKETS = 64
BUCKET, NUMBER = "_bucket", "_batch"


@dataclass(frozen=True)
class Merge:
    """(state or None, batch) -> state, row by row of the same keys."""

    keys: list[str]
    apply: Callable[[DataFrame | None, DataFrame], DataFrame]

    def __call__(self, state: DataFrame | None, batch: DataFrame) -> DataFrame:
        return self.apply(state, batch)


def keep_newest(keys: list[str], updated: str, ties: tuple[str, ...] = ()) -> Merge:
    """The newer row wins, so the order of arrival has no effect."""

    def merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        newest = latest_per_key(batch, keys, updated, ties)
        return newest if state is None else merge_newer(state, newest, keys, updated, ties)

    return Merge(keys, merge)


def upsert(keys: list[str], updated: str, ties: tuple[str, ...] = ()) -> Merge:
    """The later batch wins."""

    def merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        newest = latest_per_key(batch, keys, updated, ties)
        return newest if state is None else merge_state(state, newest, keys)

    return Merge(keys, merge)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def stored_buckets(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """Bucket -> numbers of the batches that wrote it, from the catalog alone."""
    found: dict[int, list[int]] = {}
    if exists(spark, _store(table)):
        for row in spark.sql(f"SHOW PARTITIONS {_store(table)}").collect():
            bucket, number = map(int, re.findall(r"=(\d+)", row[0]))
            found.setdefault(bucket, []).append(number)
    return found


def _store(table: str) -> str:
    return f"{table}__buckets"


def _newest(stored: dict[int, list[int]], below: int) -> dict[int, int]:
    """For each bucket the last batch before ``below`` that wrote it."""
    before = {b: [n for n in numbers if n < below] for b, numbers in stored.items()}
    return {b: max(numbers) for b, numbers in before.items() if numbers}


def _in(newest: dict[int, int]) -> str:
    """The folders as a condition on the partition columns, which prunes the others."""
    by_number: dict[int, list[int]] = {}
    for bucket, number in newest.items():
        by_number.setdefault(number, []).append(bucket)
    some = [f"({NUMBER} = {n} AND {BUCKET} IN ({', '.join(map(str, sorted(b)))}))" for n, b in sorted(by_number.items())]
    return " OR ".join(some) or "false"


def apply_batch(batch: DataFrame, table: str, merge: Merge, number: int, buckets: int = BUCKETS) -> list[int]:
    """Merge one batch into the buckets it meets and switch the name; the buckets written.

    ``number`` counts the batches from 0. Applying a batch again changes nothing. An
    empty batch writes nothing. ``buckets`` stays the same for the life of a table.
    """
    spark = batch.sparkSession
    marked = batch.withColumn(BUCKET, bucket_of(merge.keys, buckets))
    met = sorted(r[0] for r in marked.select(BUCKET).distinct().collect())  # at most one row per bucket
    newest = _newest(stored_buckets(spark, table), number)
    held = {b: newest[b] for b in met if b in newest}
    state = _read(spark, table, held, batch) if held else None
    merged = merge(state, batch).select(*batch.columns)
    placed = merged.withColumn(BUCKET, bucket_of(merge.keys, buckets)).withColumn(NUMBER, F.lit(number))
    if not exists(spark, _store(table)):
        placed.limit(0).write.partitionBy(BUCKET, NUMBER).format("parquet").saveAsTable(_store(table))
    if met:
        # buckets are gathered into files of the advisory size; a large one is written by several tasks
        out = placed.hint("rebalance", F.col(BUCKET))
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, NUMBER)
        writer.parquet(_location(spark, table))
        _listed(spark, table, "ADD IF NOT EXISTS", [(b, number) for b in met])
        spark.catalog.refreshTable(_store(table))
    stored = stored_buckets(spark, table)
    now = _newest(stored, number + 1)
    names = ", ".join(f"`{c}`" for c in batch.columns)
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT {names} FROM {_store(table)} WHERE {_in(now)}")
    _drop_replaced(spark, table, stored, number)
    return met


def _read(spark: SparkSession, table: str, folders: dict[int, int], like: DataFrame) -> DataFrame:
    """Some folders as they lie, so that a plan may read the table it writes to; no other folder is listed."""
    paths = [f"{_location(spark, table)}/{BUCKET}={b}/{NUMBER}={n}" for b, n in sorted(folders.items())]
    return spark.read.schema(like.schema).parquet(*paths).select(*like.columns)


def _location(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE TABLE EXTENDED {_store(table)}").where("col_name = 'Location'").first()["data_type"]


def _listed(spark: SparkSession, table: str, how: str, folders: list[tuple[int, int]]) -> None:
    """Folders put into the catalog, or dropped with their files; a folder is listed only when it is complete."""
    for start in range(0, len(folders), 100):
        parts = [f"PARTITION ({BUCKET} = {b}, {NUMBER} = {n})" for b, n in folders[start : start + 100]]
        spark.sql(f"ALTER TABLE {_store(table)} {how} {(' ' if how.startswith('ADD') else ', ').join(parts)}")


def _drop_replaced(spark: SparkSession, table: str, stored: dict[int, list[int]], number: int) -> None:
    """Folders that neither the state nor the one before it (for a replay and for running readers) needs."""
    before, now = _newest(stored, number), _newest(stored, number + 1)
    old = [(b, n) for b, numbers in stored.items() for n in numbers if n not in (before.get(b), now.get(b))]
    _listed(spark, table, "DROP IF EXISTS", old)


def refresh(
    source: DataFrame, table: str, merge: Merge, progress: str, every: str | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Start keeping ``table`` fresh from a streaming frame.

    ``every`` is the lag, such as "1 hour"; without it the query takes what has
    landed, batch by batch, and ends. ``progress`` is the stream's checkpoint
    folder, shared by all executors; table and folder belong together.
    """

    def publish_state(batch: DataFrame, batch_id: int) -> None:
        if batch_id > 0 and not exists(batch.sparkSession, _store(table)):
            raise RuntimeError(f"{table} lacks the state before batch {batch_id}")
        apply_batch(batch, table, merge, batch_id, buckets)

    writer = source.writeStream.foreachBatch(publish_state).option("checkpointLocation", progress)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
