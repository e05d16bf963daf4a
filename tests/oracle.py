"""Comparison of a Spark result with DuckDB's, as sets of rows."""

import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        db.execute(f"create view {name[:-8]} as from '{path}'")
    return db


def _value(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and getattr(v, "ndim", 1) == 0:
        return f"{float(v):.9g}"
    return str(v)


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(_value(v) for v in r) for r in frame.itertuples(index=False))
