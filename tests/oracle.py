"""Comparison of a Spark result with DuckDB on the same Parquet tables."""

from __future__ import annotations

import datetime
import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return int(value)
    return str(value)


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str, show: int = 3) -> str | None:
    """None if equal, else a short description."""
    cursor = connection.execute(sql)
    expected_names = [column[0] for column in cursor.description]
    expected = rows_of(expected_names, cursor.fetchall())
    names = spark_df.columns
    if sorted(names) != sorted(expected_names):
        return f"columns {sorted(names)} != {sorted(expected_names)}"
    actual = rows_of(names, spark_df.collect())
    if actual == expected:
        return None
    return (f"columns {sorted(names)}; rows {sum(actual.values())} / {sum(expected.values())}; "
            f"only spark {list((actual - expected).items())[:show]}; only sql {list((expected - actual).items())[:show]}")
