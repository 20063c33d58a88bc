"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import glob
import os

import duckdb


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = query(spark, folder), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
