"""Comparison of a query with its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import glob
import math

import duckdb


def _norm(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def compare(spark, name: str, query, sql: str, d: str) -> None:  # noqa: ANN001
    df = query(spark, d)
    columns = sorted(df.columns)
    rows = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.sql(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    r = con.sql(sql)
    assert sorted(r.columns) == columns, name
    at = [r.columns.index(c) for c in columns]
    assert rows == sorted(tuple(_norm(x[i]) for i in at) for x in r.fetchall()), name
