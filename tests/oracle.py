"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same_rows(df, con, sql):
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    got = sorted(tuple(plain(x) for x in r) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
