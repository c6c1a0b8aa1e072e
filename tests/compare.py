"""Spark against DuckDB on the same tables: rows as multisets, columns by name."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def shown(x) -> str:
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.number)):
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(shown, row)) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


def assert_same(spark_frame, con, sql: str) -> None:
    left, right = spark_frame.toPandas(), con.execute(sql).fetchdf()
    assert sorted(left.columns) == sorted(right.columns)
    assert rows(left) == rows(right)
