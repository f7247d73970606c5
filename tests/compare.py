"""Runs queries in Spark and DuckDB and compares rows by sorted values."""

from __future__ import annotations

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in values)


def compare(spark, sf_dir: str, plan, sql: str) -> str:
    """'' or what differs."""
    df = plan(spark, sf_dir)
    got = df.collect()
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} and {y}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    other = [(n, dict(df.dtypes)[n], str(d[1])) for n, d in zip(names, cur.description) if kinds.get(str(d[1]), dict(df.dtypes)[n]) != dict(df.dtypes)[n]]
    return f"types {other}" if other else ""
