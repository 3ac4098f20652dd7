"""Runs a query and its DuckDB SQL on the same tables and compares the rows as sets."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


def compare(spark, query, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{sf}/{t}.parquet')")
    expected = con.execute(sql)
    a = rows([c[0] for c in expected.description], expected.fetchall())
    df = query(spark, f"{DATA}/{sf}")
    b = rows(df.columns, df.collect())
    assert b[0] == a[0]
    assert len(b[1]) == len(a[1])
    assert b[1] == a[1]
    return len(b[1])
