"""Holds a query's rows against its SQL in DuckDB, columns by name, order ignored."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def norm(v):
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(norm, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return f"{v:.9g}"
    return str(v)


def rows(df):
    return sorted(tuple(norm(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def duck(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con
