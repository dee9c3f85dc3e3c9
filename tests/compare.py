"""Order-insensitive comparison of a Spark result with DuckDB's."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([_cell(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "~"
    if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)):
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def canonical(df: pd.DataFrame):
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(v) for v in row) for row in df[names].itertuples(index=False))
