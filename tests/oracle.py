"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

import __spark_entry__ as entry

ROOT = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(d)):
        path = f"{d}/{name}" + ("/*.parquet" if os.path.isdir(f"{d}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def compare(spark, name: str, sf: str = "sf0.001") -> tuple[Counter, Counter]:
    """Rows only Spark has, rows only the SQL has."""
    d = f"{ROOT}/{sf}"
    df = entry.queries()[name](spark, d)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(d).execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    theirs = rows(columns, rel.fetchall())
    assert sorted(columns) == sorted(df.columns), (columns, df.columns)
    return ours - theirs, theirs - ours
