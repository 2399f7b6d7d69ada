"""Rows of a query and of its SQL, in one form."""

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def connection(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) if abs(v) < 2**53 else int(v)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


def rows(frame: pd.DataFrame) -> Counter:
    return Counter(tuple(map(value, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))
