"""Compares a query with its SQL in DuckDB."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return round(float(v), 9) if isinstance(v, decimal.Decimal) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


def sql_rows(con, sql):
    q = con.execute(sql)
    names = [d[0] for d in q.description]
    cols = sorted(names)
    return cols, sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=str)


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
