"""Runs SQL in DuckDB over a data folder and compares it with a Spark result."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_frame(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con.sql(sql).df()


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.6f}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))
