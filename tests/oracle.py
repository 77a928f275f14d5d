"""Runs a query's SQL in DuckDB over the same tables and compares rows without regard to order."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


def same_rows(df, con, sql):
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    want = sorted(tuple(plain(dict(zip(rel.columns, r, strict=True))[n]) for n in names) for r in rel.fetchall())
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
