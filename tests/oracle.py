"""Side-by-side comparison of a Spark query and its DuckDB oracle."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if value is None:
        return "~null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    spark_rows = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    expected = rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(spark_rows) != len(expected):
        return f"rows {len(spark_rows)} vs {len(expected)}"
    for a, b in zip(spark_rows, expected):
        if a != b:
            short = lambda r: tuple(x[:120] for x in r)
            return f"{sorted(names)}\n  spark  {short(a)}\n  oracle {short(b)}\n  {sum(x != y for x, y in zip(spark_rows, expected))} rows differ; types {types} / {df.dtypes}"
    return None
