"""Rows of a query and of its SQL in DuckDB, ready to compare."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)


def sql_rows(sql, folder):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
    return [found.columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=str)
