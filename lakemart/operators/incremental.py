"""Incremental loads behind a high-water mark."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.functions.clean import as_date

# Fixed value: the mark of a target that holds no rows yet.
EMPTY_TARGET_MARK = dt.date(2010, 1, 1)


def high_water(target: DataFrame, load_column: str, default: dt.date = EMPTY_TARGET_MARK):
    """The newest load date or time in the target; one aggregate over one column."""
    newest = target.agg(F.max(load_column)).first()[0]
    return default if newest is None else newest


def newer_than(load_time: str | Column, mark: dt.date | dt.datetime, granularity: str = "day") -> Column:
    """Rows strictly past the mark.

    The mark is a literal, not a subquery, so the condition reaches the scan.
    With ``day`` a later batch of an already loaded day is left out for good;
    ``timestamp`` compares the full time. Rows without a load time never pass.
    """
    column = F.col(load_time) if isinstance(load_time, str) else load_time
    if granularity == "day":
        day = mark.date() if isinstance(mark, dt.datetime) else mark
        return as_date(column) > F.lit(day)
    if granularity == "timestamp":
        moment = mark if isinstance(mark, dt.datetime) else dt.datetime.combine(mark, dt.time())
        return column > F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    raise ValueError("granularity must be 'day' or 'timestamp'")


def incremental_rows(
    source: DataFrame,
    target: DataFrame | None,
    load_time: str,
    load_column: str,
    granularity: str = "day",
    default: dt.date = EMPTY_TARGET_MARK,
) -> DataFrame:
    """Source rows the target has not seen. Without a target (first run) all of them."""
    if target is None:
        return source
    return source.where(newer_than(load_time, high_water(target, load_column, default), granularity))
