"""Check snapshots: a new version whenever a checked column differs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.functions.compare import any_changed, side_pairs
from lakemart.operators.scd2 import OPEN_END

SNAPSHOT_COLUMNS = ("valid_from", "valid_to", "updated_at", "version_id")


def _moment(value: dt.datetime | dt.date | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def snapshot_open(
    batch: DataFrame, key: str, run_time: dt.datetime, open_end: str = OPEN_END
) -> DataFrame:
    """The batch as open versions of one run."""
    now = _moment(run_time)
    stamp = F.md5(F.concat_ws("|", F.col(key).cast("string"), now.cast("string")))
    return batch.select(
        "*",
        now.alias("valid_from"),
        _moment(open_end).alias("valid_to"),
        now.alias("updated_at"),
        stamp.alias("version_id"),
    )


def is_open(open_end: str = OPEN_END) -> Column:
    return F.col("valid_to") == _moment(open_end)


def snapshot_delta(
    open_rows: DataFrame,
    batch: DataFrame,
    key: str,
    check_columns: list[str],
    run_time: dt.datetime,
    open_end: str = OPEN_END,
) -> DataFrame:
    """What a run makes of the open versions: still open, ended now, and new ones.

    There is one open version and one batch row per key, so a single outer join
    sees both sides.
    """
    now = _moment(run_time)
    versions = snapshot_open(batch, key, run_time, open_end)
    joined = (
        open_rows.withColumn("_t", F.lit(True))
        .alias("t")
        .join(
            versions.withColumn("_s", F.lit(True)).alias("s"),
            F.col(f"t.`{key}`") == F.col(f"s.`{key}`"),
            "full_outer",
        )
        .withColumn("_differs", any_changed(side_pairs(check_columns, "t", "s")))
    )
    replaced = F.col("s._s").isNotNull() & F.col("_differs")
    valid_to = F.when(replaced, now).otherwise(F.col("t.valid_to"))
    names = open_rows.columns
    stays = F.struct(*[(valid_to if c == "valid_to" else F.col(f"t.`{c}`")).alias(c) for c in names])
    comes = F.struct(*[F.col(f"s.`{c}`").alias(c) for c in names])
    rows = F.array_compact(
        F.array(
            F.when(F.col("t._t").isNotNull(), stays),
            F.when(F.col("s._s").isNotNull() & (F.col("t._t").isNull() | F.col("_differs")), comes),
        )
    )
    return joined.select(F.inline(rows))


def snapshot_check(
    target: DataFrame | None,
    batch: DataFrame,
    key: str,
    check_columns: list[str],
    run_time: dt.datetime,
    open_end: str = OPEN_END,
) -> DataFrame:
    """The new state of a snapshot table. The batch holds one row per key.

    Keys missing from the batch stay open. Columns outside ``check_columns``
    are stored with a version but never open one.
    """
    if target is None:
        return snapshot_open(batch, key, run_time, open_end)
    current, past = target.where(is_open(open_end)), target.where(~is_open(open_end))
    return snapshot_delta(current, batch, key, check_columns, run_time, open_end).unionByName(past)
