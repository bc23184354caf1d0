"""Null-safe comparison of column lists."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_changed(pairs: list[tuple[Column, Column]]) -> Column:
    """True where at least one pair differs; NULL equals NULL."""
    return reduce(or_, [~left.eqNullSafe(right) for left, right in pairs])


def all_same(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(and_, [left.eqNullSafe(right) for left, right in pairs])


def all_equal(pairs: list[tuple[Column, Column]]) -> Column:
    """Plain equality: a NULL on either side matches nothing."""
    return reduce(and_, [left == right for left, right in pairs])


def same_beside_key(pairs: list[tuple[Column, Column]]) -> Column:
    """``all_same`` in a form that stays out of the join keys.

    For joins whose sides already lie partitioned by the other keys: as a join
    key, the pairs would force both sides into another shuffle.
    """
    return ~F.array_contains(F.array(*[~left.eqNullSafe(right) for left, right in pairs]), True)


def side_pairs(columns: list[str], left: str, right: str) -> list[tuple[Column, Column]]:
    """``left.c`` beside ``right.c`` for aliased join sides."""
    return [(F.col(f"{left}.`{c}`"), F.col(f"{right}.`{c}`")) for c in columns]


def any_null(columns: list[str]) -> Column:
    return reduce(or_, [F.col(f"`{c}`").isNull() for c in columns])
