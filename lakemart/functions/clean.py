"""Cleaning expressions used by the transform models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_if_null(c: str | Column) -> Column:
    return F.coalesce(as_column(c), F.lit(""))


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(as_column(c), F.lit(0))


def first_present(*columns: str | Column, default: str = "") -> Column:
    return F.coalesce(*[as_column(c) for c in columns], F.lit(default))


def as_date(c: str | Column) -> Column:
    # a plain cast: the optimizer turns a comparison on it into a range on the timestamp
    return as_column(c).cast("date")
