"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("number", round(value, 6))
    if isinstance(value, Decimal):
        return ("decimal", value.normalize())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return (type(value).__name__, value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(row[n]) for n in names) for row in df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in result.fetchall())


def differences(df, con, sql) -> str | None:
    names, ours = spark_rows(df)
    expected_names, theirs = sql_rows(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if ours != theirs:
        return (
            f"rows {sum(ours.values())} vs {sum(theirs.values())}; only ours {list((ours - theirs).items())[:2]}; "
            f"only SQL {list((theirs - ours).items())[:2]}"
        )
    return None
