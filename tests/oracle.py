"""Comparison of a query's rows with those of its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> None:
    assert sorted(spark_rows.columns) == sorted(sql_rows.columns)
    assert len(spark_rows) == len(sql_rows)
    pd.testing.assert_frame_equal(canonical(spark_rows), canonical(sql_rows))
