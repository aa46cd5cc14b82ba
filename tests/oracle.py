"""Compares a query's rows with those of its SQL on DuckDB, whatever their order."""

import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    if hasattr(v, "tzinfo"):
        v = v.replace(tzinfo=None)
    return repr(v)


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    expected = sorted(tuple(norm(r[i]) for i in order) for r in got.fetchall())
    actual = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert actual == expected
