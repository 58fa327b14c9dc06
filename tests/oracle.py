"""A query's rows and those of its SQL in DuckDB, in a comparable form."""

import datetime
import os

import duckdb

ROOT = os.environ.get("QUILLON_TESTDATA", "/root/testdata")


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(round(x, 9) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def duck_rows(sql, sf):
    con = duckdb.connect()
    for f in os.listdir(f"{ROOT}/{sf}"):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{sf}/{f}'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    return names, sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall())
