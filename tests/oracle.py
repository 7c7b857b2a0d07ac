"""Compares a query with its SQL in DuckDB, as sets of rows with columns by name."""

import os

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows_of(pdf):
    cols = sorted(pdf.columns)

    def plain(v):
        if v is None or (isinstance(v, float) and np.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (float, np.floating, int, np.integer)):
            return round(float(v), 5)
        return str(v)

    return cols, sorted(tuple(map(str, map(plain, r))) for r in pdf[cols].itertuples(index=False))


def assert_same(spark, query, sql, sf=SF):
    got, want = rows_of(query(spark, sf).toPandas()), rows_of(connection(sf).sql(sql).fetchdf())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
