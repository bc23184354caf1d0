"""Upserts as pure functions: (target, batch) -> new target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.functions.compare import all_equal, all_same, any_null, side_pairs
from lakemart.operators.dedupe import latest_per_key


def unique_batch(batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; the job fails when two different rows share one, equal rows count once.

    The smallest and the largest row of a key must be the same. Both are found in one
    shuffle, after rows are reduced inside each task, so repeated keys cannot pile up.
    """
    others = [c for c in batch.columns if c not in keys]
    row = F.struct(*others) if others else F.lit(0)
    grouped = batch.groupBy(*keys).agg(F.min(row).alias("_row"), F.max(row).alias("_top"))
    clash = F.concat(F.lit("more than one batch row for key "), F.to_json(F.struct(*keys)))
    alike = F.col("_row").eqNullSafe(F.col("_top"))
    once = grouped.where(F.when(alike, True).otherwise(F.raise_error(clash).cast("boolean")))
    return once.select(*[F.col(f"_row.`{c}`") if c in others else F.col(c) for c in batch.columns])


def merge_state(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    update_columns: list[str] | None = None,
    null_safe_keys: bool = False,
    insert_new: bool = True,
    batch_keys: DataFrame | None = None,
    not_older: str | None = None,
) -> DataFrame:
    """Matched rows take the batch's values, new rows come in, all others stay.

    ``update_columns`` limits what a matched row takes over. Unless
    ``null_safe_keys``, a key with a NULL part matches nothing and its rows come
    in again with every batch. The batch must hold one row per key (see
    ``unique_batch`` and ``merge_latest``). ``not_older`` names a time column: a
    batch row that is older there than the stored row changes nothing.

    The target is never on the broadcast side: Spark broadcasts the batch when
    it measures it to be small, and then the target is not shuffled at all;
    otherwise it is shuffled once.
    """
    if set(target.columns) != set(batch.columns):
        raise ValueError(f"columns differ: {sorted(set(target.columns) ^ set(batch.columns))}")
    same = all_same if null_safe_keys else all_equal
    on = same(side_pairs(keys, "t", "s"))
    matchable, loose = (target, None) if null_safe_keys else _split_null_keys(target, keys)

    if update_columns is None:
        if not_older or not insert_new:
            update_columns = [c for c in target.columns if c not in keys]
        else:
            incoming = batch.select(*keys) if batch_keys is None else batch_keys
            kept = matchable.alias("t").join(incoming.alias("s"), on, "left_anti")
            return _union(kept, loose, batch)

    taken = dict.fromkeys([*keys, *update_columns, *([not_older] if not_older else [])])
    patch = batch.select(*taken).withColumn("_hit", F.lit(True))
    hit = F.col("s._hit")
    if not_older:
        stored, given = F.col(f"t.`{not_older}`"), F.col(f"s.`{not_older}`")
        hit = hit & (stored.isNull() | (given >= stored))
    merged = (
        matchable.alias("t")
        .join(patch.alias("s"), on, "left")
        .select(
            *[
                F.when(hit, F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c)
                if c in update_columns
                else F.col(f"t.`{c}`")
                for c in target.columns
            ]
        )
    )
    fresh = None
    if insert_new:
        fresh_batch, fresh_loose = (batch, None) if null_safe_keys else _split_null_keys(batch, keys)
        fresh = _union(_unknown(matchable, fresh_batch, keys, same), fresh_loose)
    return _union(merged, loose, fresh)


def _unknown(target: DataFrame, batch: DataFrame, keys: list[str], same) -> DataFrame:
    """Batch rows whose key the target lacks.

    The target's keys are first reduced to those of the batch, with the batch on
    the side that may be broadcast; only that remainder meets the batch again.
    """
    met = target.select(*keys).alias("t").join(
        batch.select(*keys).alias("s"), same(side_pairs(keys, "t", "s")), "left_semi"
    )
    return batch.alias("s").join(met.alias("t"), same(side_pairs(keys, "s", "t")), "left_anti")


def merge_newer(
    target: DataFrame, batch: DataFrame, keys: list[str], updated: str, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Merge in which a batch row replaces an older row only; both sides hold one row per key."""

    def place(side: str):
        # a NULL time is older than any other, as in the descending order of latest_per_key
        return F.struct(*[F.col(f"{side}.`{c}`") for c in (updated, *ties)])

    wins = F.col("s._hit").isNotNull() & (place("s") > place("t"))
    kept = (
        target.alias("t")
        .join(batch.withColumn("_hit", F.lit(True)).alias("s"), all_same(side_pairs(keys, "t", "s")), "left")
        .select(*[F.when(wins, F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c) for c in target.columns])
    )
    return kept.unionByName(_unknown(target, batch, keys, all_same))


def merge_latest(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    updated: str,
    ties: tuple[str, ...] = (),
    update_columns: list[str] | None = None,
    null_safe_keys: bool = False,
    nulls: str = "last",
    columns: list[str] | None = None,
    not_older: str | None = None,
) -> DataFrame:
    """Dedupe the source to its newest row per key, then merge those of its ``columns`` wanted."""
    batch = latest_per_key(source, keys, updated, ties, nulls)
    if columns:
        batch = batch.select(*columns)
    known = source.select(*keys).distinct()
    return merge_state(
        target, batch, keys, update_columns, null_safe_keys, batch_keys=known, not_older=not_older
    )


def merge_distinct(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the distinct source rows; two different rows of one key fail the job."""
    batch = unique_batch(source, keys)
    return merge_state(target, batch, keys, batch_keys=source.select(*keys).distinct())


def append_all(target: DataFrame, batch: DataFrame) -> DataFrame:
    """A merge without a key: nothing can match, so every batch row is inserted."""
    return target.unionByName(batch)


def _split_null_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that can match, and rows with a NULL key part.

    The second part bypasses the join, where it would gather in one task. Its
    scan skips every row group whose statistics show no NULL key.
    """
    loose = any_null(keys)
    return df.where(~loose), df.where(loose)


def _union(first: DataFrame, *others: DataFrame | None) -> DataFrame:
    for other in others:
        if other is not None:
            first = first.unionByName(other)
    return first
