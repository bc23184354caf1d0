"""Type 2 history: first load, closing, incremental load, rebuild from a change log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.functions.compare import all_same, any_changed, same_beside_key, side_pairs
from lakemart.operators.dedupe import latest_per_key
from lakemart.operators.ordered import (
    OrderedRows,
    ordered_rows,
    with_next,
    with_previous,
    with_running_total,
)

# The end of an open version and the columns a version carries.
OPEN_END = "9999-12-31"
VERSION_COLUMNS = ("start_dt", "end_dt", "is_active")


def _open_version(df: DataFrame, columns: list[str], updated: str, end: str) -> DataFrame:
    kind = df.schema[updated].dataType
    return df.select(
        *columns,
        F.col(updated).alias("start_dt"),
        F.lit(dt.date.fromisoformat(end)).cast(kind).alias("end_dt"),
        F.lit(True).alias("is_active"),
    )


def scd2_seed(
    source: DataFrame,
    key: str,
    updated: str,
    tracked: list[str],
    passthrough: tuple[str, ...] = (),
    end: str = OPEN_END,
    ties: tuple[str, ...] = (),
    nulls: str = "last",
) -> DataFrame:
    """First load: the newest row of every key as one open version."""
    newest = latest_per_key(source, key, updated, ties, nulls)
    return _open_version(newest, [key, *tracked, *passthrough], updated, end)


def close_open(
    open_rows: DataFrame,
    source: DataFrame,
    key: str,
    updated: str,
    tracked: list[str],
    ties: tuple[str, ...] = (),
    nulls: str = "last",
) -> DataFrame:
    """Open versions; those that differ from the newest source row end at its update time."""
    newest = latest_per_key(source, key, updated, ties, nulls).select(
        key, *tracked, F.col(updated).alias("_ends")
    )
    hit = (F.col(f"t.`{key}`") == F.col(f"s.`{key}`")) & any_changed(side_pairs(tracked, "t", "s"))
    joined = open_rows.alias("t").join(newest.withColumn("_hit", F.lit(True)).alias("s"), hit, "left")
    ended = F.coalesce(F.col("s._hit"), F.lit(False))
    replaced = {
        "end_dt": F.when(ended, F.col("s._ends")).otherwise(F.col("t.end_dt")),
        "is_active": ~ended,
    }
    return joined.select(*[replaced.get(c, F.col(f"t.`{c}`")).alias(c) for c in open_rows.columns])


def scd2_close(
    target: DataFrame,
    source: DataFrame,
    key: str,
    updated: str,
    tracked: list[str],
    ties: tuple[str, ...] = (),
    nulls: str = "last",
) -> DataFrame:
    """The table after closing; closed versions are passed on without a join."""
    open_rows, closed_rows = _split_open(target)
    return close_open(open_rows, source, key, updated, tracked, ties, nulls).unionByName(closed_rows)


def _split_open(target: DataFrame) -> tuple[DataFrame, DataFrame]:
    is_open = F.coalesce(F.col("is_active"), F.lit(False))
    return target.where("is_active"), target.where(~is_open)


def scd2_new_versions(
    target: DataFrame,
    source: DataFrame,
    key: str,
    updated: str,
    tracked: list[str],
    passthrough: tuple[str, ...] = (),
    end: str = OPEN_END,
    match_scope: str = "any",
    ties: tuple[str, ...] = (),
    nulls: str = "last",
) -> DataFrame:
    """The versions an incremental load adds.

    ``any``: the newest source row per key among those equal to no stored
    version, open or closed. A key that returns to an earlier content gets no
    open version, and older unseen rows of the source surface later.
    ``active``: the newest source row per key, unless the open version equals it.
    """
    versions = target.select(key, *tracked, "is_active")
    same_key = F.col(f"s.`{key}`") == F.col(f"t.`{key}`")
    if match_scope == "any":
        # the whole content is a join key, so rows of a busy key spread over tasks
        known = same_key & all_same(side_pairs(tracked, "s", "t"))
        unseen = source.alias("s").join(versions.drop("is_active").alias("t"), known, "left_anti")
        rows = latest_per_key(unseen, key, updated, ties, nulls)
    elif match_scope == "active":
        newest = latest_per_key(source, key, updated, ties, nulls)
        # both sides have few rows per key: joined on the key alone, as they are already partitioned
        known = same_key & same_beside_key(side_pairs(tracked, "s", "t"))
        rows = newest.alias("s").join(versions.where("is_active").alias("t"), known, "left_anti")
    else:
        raise ValueError("match_scope must be 'any' or 'active'")
    return _open_version(rows, [key, *tracked, *passthrough], updated, end)


def scd2_delta(
    open_rows: DataFrame,
    versions: DataFrame,
    source: DataFrame,
    key: str,
    updated: str,
    tracked: list[str],
    passthrough: tuple[str, ...] = (),
    end: str = OPEN_END,
    match_scope: str = "any",
    ties: tuple[str, ...] = (),
    nulls: str = "last",
) -> DataFrame:
    """What a load makes of the open slice: rows still open, rows closed now, new rows.

    Versions closed before are not part of it. ``versions`` are all stored
    versions; only ``match_scope="any"`` reads them, and of these just the key
    and the tracked columns.
    """
    if match_scope == "active":
        return _turn_over(open_rows, source, key, updated, tracked, passthrough, end, ties, nulls)
    closed = close_open(open_rows, source, key, updated, tracked, ties, nulls)
    added = scd2_new_versions(
        versions, source, key, updated, tracked, passthrough, end, match_scope, ties, nulls
    )
    return closed.unionByName(added)


def _turn_over(
    open_rows: DataFrame,
    source: DataFrame,
    key: str,
    updated: str,
    tracked: list[str],
    passthrough: tuple[str, ...],
    end: str,
    ties: tuple[str, ...],
    nulls: str,
) -> DataFrame:
    """Close and load of the open slice in one join, reading the source once.

    The open versions of a key, as a rule one, are packed into one row, so each
    side of the join has one row per key.
    """
    newest = latest_per_key(source, key, updated, ties, nulls)
    loaded = _open_version(newest, [key, *tracked, *passthrough], updated, end).withColumn("_hit", F.lit(True))
    names = open_rows.columns
    packed = open_rows.groupBy(key).agg(F.collect_list(F.struct(*names)).alias("_open"))
    joined = packed.alias("t").join(loaded.alias("s"), F.col(f"t.`{key}`") == F.col(f"s.`{key}`"), "full_outer")

    there = F.col("s._hit").isNotNull()
    row = F.struct(*[F.col(f"s.`{c}`").alias(c) for c in names])
    none = F.filter(F.array(row), lambda r: F.lit(False))
    stored = F.coalesce(F.col("t._open"), none)

    def pairs(version: Column) -> list[tuple[Column, Column]]:
        return [(version[c], F.col(f"s.`{c}`")) for c in tracked]

    def after(version: Column) -> Column:
        ended = {"end_dt": F.col("s.start_dt"), "is_active": F.lit(False)}
        closed = F.struct(*[ended.get(c, version[c]).alias(c) for c in names])
        return F.when(there & any_changed(pairs(version)), closed).otherwise(version)

    known = F.exists(stored, lambda version: all_same(pairs(version)))
    added = F.when(there & ~known, F.array(row)).otherwise(none)
    return joined.select(F.inline(F.concat(F.transform(stored, after), added)))


def scd2_incremental(
    target: DataFrame,
    source: DataFrame,
    key: str,
    updated: str,
    tracked: list[str],
    passthrough: tuple[str, ...] = (),
    end: str = OPEN_END,
    match_scope: str = "any",
    ties: tuple[str, ...] = (),
    nulls: str = "last",
) -> DataFrame:
    """Close and load in one new state, so no reader sees a key between the two."""
    open_rows, closed_rows = _split_open(target)
    delta = scd2_delta(
        open_rows, target, source, key, updated, tracked, passthrough, end, match_scope, ties, nulls
    )
    return delta.unionByName(closed_rows)


def _changes(
    source: DataFrame,
    key: str,
    updated: str,
    tracked: list[str],
    others: list[str],
    ties: tuple[str, ...],
    keep_first: bool,
    slices: int | None,
) -> OrderedRows:
    """Rows in which at least one tracked column differs from the row before."""
    if not tracked:
        raise ValueError("tracked must name at least one column")
    columns = list(dict.fromkeys([key, *tracked, *others, updated, *ties]))
    rows = with_previous(ordered_rows(source.select(*columns), key, updated, ties, slices), tracked)
    changed = any_changed([(F.col(c), F.col(f"_prev.`{c}`")) for c in tracked])
    if keep_first:
        changed = changed | F.col("_prev").isNull()
    kept = rows.where(changed)
    return kept.with_df(kept.df.drop("_prev"))


def scd2_rebuild(
    source: DataFrame,
    key: str,
    updated: str,
    tracked: list[str],
    created: str | None = None,
    end: str = OPEN_END,
    ties: tuple[str, ...] = (),
    keep_first: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """All versions from a change log: keep the changes and chain them.

    Without hot keys this is one shuffle and one sort: the second window reuses
    the order of the first. A first row whose tracked columns are all NULL
    counts as no change unless ``keep_first``.
    """
    kept = [c for c in [created] if c]
    changes = _changes(source, key, updated, tracked, kept, ties, keep_first, slices)
    chained = with_next(changes, "_next").result()
    kind = source.schema[updated].dataType
    return chained.select(
        key,
        *tracked,
        *kept,
        updated,
        F.col(updated).alias("start_dt"),
        F.coalesce(F.col("_next"), F.lit(dt.date.fromisoformat(end)).cast(kind)).alias("end_dt"),
        F.col("_next").isNull().alias("is_active"),
    )


def change_streak(
    source: DataFrame,
    key: str,
    updated: str,
    tracked: list[str],
    ties: tuple[str, ...] = (),
    keep_first: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """The running number of changes of a key, at each change."""
    changes = _changes(source, key, updated, tracked, [], ties, keep_first, slices)
    counted = with_running_total(changes, F.lit(1), "streak").result()
    return counted.select(key, updated, *tracked, F.col("streak").cast("long").alias("streak"))
