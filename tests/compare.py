"""A query's rows against its SQL's, whatever their order."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def sql_rows(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def assert_equal(df, sql: str, sf_dir: str):
    columns, rows = sql_rows(sql, sf_dir)
    names = sorted(df.columns)
    assert names == sorted(columns)
    at = [columns.index(n) for n in names]
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)
    assert ours
