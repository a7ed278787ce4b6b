"""Compare a query's rows with those of its SQL counterpart."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return ("dec", str(value.normalize()))
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, datetime):
        return value.isoformat(timespec="microseconds")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, float):
        return repr(value)
    return ("int", int(value))


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> str | None:
    """None when both sides hold the same rows under the same column names."""
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = _bag(df.columns, df.collect()), _bag(names, result.fetchall())
    if left == right:
        return None
    return (
        f"{sum(left.values())} rows against {sum(right.values())}; "
        f"only ours {list((left - right).items())[:3]}; only SQL {list((right - left).items())[:3]}"
    )
