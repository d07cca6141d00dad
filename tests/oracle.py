"""Runs SQL in DuckDB over the test tables and compares results as bags of rows."""

import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c.sql(sql).df()


def same(df, sql, folder):
    a, b = df.toPandas(), duck(sql, folder)
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert len(a) == len(b)
    for x in (a, b):
        for c in columns:
            if x[c].dtype == object:
                x[c] = x[c].astype(str)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (a, b))
    for c in columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
