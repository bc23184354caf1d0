"""One row per key, or one row per distinct content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(updated: str, ties: tuple[str, ...] = (), nulls: str = "last") -> list[Column]:
    """Descending order on the update time, then on the tie-breakers.

    ``nulls="first"`` lets a row without an update time win its key, which is
    what a warehouse does whose descending order starts with NULLs.
    """
    if nulls not in ("first", "last"):
        raise ValueError("nulls must be 'first' or 'last'")
    head = F.col(updated).desc_nulls_last() if nulls == "last" else F.col(updated).desc_nulls_first()
    return [head, *[F.col(t).desc_nulls_last() for t in ties]]


def latest_per_key(
    df: DataFrame,
    keys: str | list[str],
    updated: str,
    ties: tuple[str, ...] = (),
    nulls: str = "last",
) -> DataFrame:
    """The newest row of every key; NULL keys form one group.

    The rank filter becomes a group limit before the shuffle, so each task sends
    at most one row per key and a hot key costs no more than any other.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = Window.partitionBy(*keys).orderBy(*newest_first(updated, ties, nulls))
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()
