"""Runs a query and its SQL on the same small tables and compares them as multisets of rows."""

import datetime
import decimal
import glob
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connection(folder: str = FOLDER):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, (bool, int, float, decimal.Decimal)):
        return f"{round(float(v), 5) + 0.0:.5f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ", "seconds")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def compare(spark, con, run, sql, folder: str = FOLDER):
    df = run(spark, folder)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = con.execute(sql)
    columns = [x[0] for x in result.description]
    assert sorted(columns) == names
    wanted = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert got == wanted
