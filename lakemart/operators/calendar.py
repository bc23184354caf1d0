"""The date dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_dimension(bounds: DataFrame, first: str | Column = "first", last: str | Column = "last") -> DataFrame:
    """One row per day between two dates of a one-row frame; ISO weekdays, Monday is 1.

    The number of rows is set by the calendar, not by the data it is read from.
    """
    days = bounds.select(
        F.col(first).alias("_first") if isinstance(first, str) else first.alias("_first"),
        F.col(last).alias("_last") if isinstance(last, str) else last.alias("_last"),
    ).select(
        "_first", F.explode(F.sequence("_first", "_last", F.make_dt_interval(F.lit(1)))).alias("date")
    )
    weekday = F.weekday("date") + 1
    month_end = F.col("date") == F.last_day("date")
    month_start = F.dayofmonth("date") == 1
    return days.select(
        (F.date_diff("date", "_first") + 1).cast("long").alias("date_sk"),
        "date",
        F.dayofmonth("date").alias("day"),
        F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.quarter("date").alias("quarter"),
        F.year("date").alias("year"),
        weekday.alias("day_of_week"),
        F.date_format("date", "EEEE").alias("day_name"),
        (weekday >= 6).alias("is_weekend"),
        month_end.alias("is_month_end"),
        month_start.alias("is_month_start"),
        (month_end & (F.month("date") % 3 == 0)).alias("is_quarter_end"),
        (month_start & (F.month("date") % 3 == 1)).alias("is_quarter_start"),
    )


def days_between(df: DataFrame, column: str) -> DataFrame:
    """The first and last day of a column, as bounds for ``date_dimension``."""
    return df.agg(F.min(column).cast("date").alias("first"), F.max(column).cast("date").alias("last"))
