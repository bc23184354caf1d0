"""Roll a fact up by attributes of its dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star_rollup(
    fact: DataFrame,
    dimensions: list[tuple[DataFrame, str | list[str]]],
    by: list[str],
    measures: list[Column],
) -> DataFrame:
    """Join the dimensions on their keys in the given order, then aggregate.

    No side is broadcast by hint: Spark broadcasts a dimension it measures to be
    small, and a large one is joined by sort-merge with hot keys split by the
    skew join. Sums are partial before the last shuffle.
    """
    joined = fact
    for dimension, key in dimensions:
        joined = joined.join(dimension, key)
    return joined.groupBy(*by).agg(*measures)


def eager_rollup(
    fact: DataFrame,
    small: list[tuple[DataFrame, str]],
    large: list[tuple[DataFrame, str]],
    by: list[str],
    sums: list[str],
    count: str = "rows",
) -> DataFrame:
    """Sums and row counts by attributes, the fact summed up before each large dimension is met.

    The small dimensions are joined first, where the fact is scanned. Before a large
    one only its key, the keys of those after it and the attributes found so far are
    still needed, so rows that agree in them become one: a hot key is summed inside
    the tasks and at most one row per attributes is left of it for the join. Join
    dimensions of a dimension to it beforehand, so the fact never meets them. Rows
    without a match or with a NULL key go, as in ``star_rollup``; an empty fact gives
    no rows.
    """
    joined = fact.withColumn(count, F.lit(1).cast("long"))
    totals = [F.sum(c).alias(c) for c in [count, *sums]]
    for dimension, key in small:
        joined = joined.join(dimension, key)
    for place, (dimension, key) in enumerate(large):
        ahead = [k for _, k in large[place:]]
        found = [c for c in by if c in joined.columns and c not in ahead]
        joined = joined.where(F.col(key).isNotNull()).groupBy(*ahead, *found).agg(*totals).join(dimension, key)
    return joined.groupBy(*by).agg(*totals)
