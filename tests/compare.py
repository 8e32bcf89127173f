"""Run a registered query and its SQL on the same tables and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("float", round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    raise TypeError(type(value))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, db, sql: str) -> str | None:
    left = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = db.execute(sql)
    right = table([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
