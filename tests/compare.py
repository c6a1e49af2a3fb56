"""Compare a registered query with its SQL on the same tables, order aside."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return str([plain(v) for v in value])
    if pd.isna(value):
        return None
    return round(value, 6) if isinstance(value, float) else value.isoformat() if hasattr(value, "isoformat") else value


def rows_of(frame, columns):
    return sorted((tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False)), key=repr)


def same(spark, query, sql, sf_dir=DATA):
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    expected = connection.sql(sql).df()
    assert sorted(expected.columns) == columns
    got = got.toPandas()
    assert rows_of(got, columns) == rows_of(expected, columns)
    return len(got)
