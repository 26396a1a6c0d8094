"""Runs a query's SQL in DuckDB over the same tables and compares whole results."""

from __future__ import annotations

import datetime
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark_rows, columns: list[str], relation: duckdb.DuckDBPyRelation) -> None:
    columns = sorted(columns)
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in spark_rows)
    want = sorted(tuple(plain(r[i]) for i in place) for r in relation.fetchall())
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not different, different[:3]
