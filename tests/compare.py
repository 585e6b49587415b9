"""Comparing a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, bool) or value is None or isinstance(value, int):
        return value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(float(value)) if isinstance(value, float) else str(value)


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    rows = sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted((tuple(canon(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert rows == wanted
