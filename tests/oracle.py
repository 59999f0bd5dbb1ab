"""Run registered queries beside their SQL and compare rows by value, whatever their order."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        number = float(value)
        return None if math.isnan(number) else round(number, 6) + 0.0
    return str(value)


def row_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def normal(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=row_key)


def difference(spark_rows, sql_rows) -> str | None:
    """None where both sides agree, else what differs."""
    (a_names, a), (b_names, b) = spark_rows, sql_rows
    if a_names != b_names:
        return f"columns {a_names} / {b_names}"
    if len(a) != len(b):
        only_a, only_b = set(a) - set(b), set(b) - set(a)
        return f"rows {len(a)} / {len(b)}; only spark {sorted(only_a, key=row_key)[:2]}; only sql {sorted(only_b, key=row_key)[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {x} / {y}"
    return None


def compare(spark, con, fn, sql: str, sf: str) -> str | None:
    df = fn(spark, sf)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return difference(got, normal(names, result.fetchall()))
