"""Spark's rows against DuckDB's."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return tuple(plain(v) for v in x) if isinstance(x, (list, tuple)) else round(x, 9) if isinstance(x, float) else x


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((plain([r[i] for i in order]) for r in found.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((plain(list(r)) for r in df.select(*names).collect()), key=repr)
