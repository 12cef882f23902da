"""Compare a Spark result with an independent SQL result over the same tables."""

from __future__ import annotations

import datetime
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def sql_engine(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return ("decimal", str(value.normalize()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> str | None:
    rows = df.collect()
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    have, want = bag(df.columns, rows), bag(names, expected)
    if have != want:
        return (f"{len(rows)} rows against {len(expected)}; only Spark: "
                f"{list((have - want).items())[:3]}; only SQL: {list((want - have).items())[:3]}")
    return None
