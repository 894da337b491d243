"""Comparison of a Spark result with DuckDB's answer to the same question on the same files."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def answer(sql: str, folder: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for path in Path(folder).iterdir():
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"CREATE VIEW {path.name.removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    return con.sql(sql).df()


def _plain(v) -> str:
    if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(int(v))
    if isinstance(v, (int, float, np.number)):
        return f"{float(v):.6g}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
