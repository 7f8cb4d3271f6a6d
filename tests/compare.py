"""Runs queries beside their SQL over one folder of tables and compares the rows."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(names: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in values)


def differ(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    return "" if a == b else f"{len(a)} rows and {len(b)}; first that differ: {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
