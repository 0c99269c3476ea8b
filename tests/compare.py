"""Rows of a Spark query against those of its SQL in DuckDB."""

import collections
import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def assert_same(df, con, sql):
    names = sorted(df.columns)
    got = collections.Counter(repr([plain(x) for x in r]) for r in df.select(*[f"`{c}`" for c in names]).collect())
    r = con.execute(sql)
    found = [c[0] for c in r.description]
    assert sorted(found) == names
    order = [found.index(c) for c in names]
    want = collections.Counter(repr([plain(row[i]) for i in order]) for row in r.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
