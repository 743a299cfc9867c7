"""Comparing a query's rows with its SQL's, whatever the order of rows and columns."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks elements extractions file_state file_listing retrievals citations golden_cases".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if path.is_file() else path / '*.parquet'}')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{v:.10g}")
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> list[str]:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"]
    a, b = rows(spark_frame), rows(sql_frame)
    if a == b:
        return []
    from collections import Counter

    x, y = Counter(a), Counter(b)
    return [f"{len(a)} and {len(b)} rows", *[f"only Spark: {r}" for r in list((x - y))[:3]], *[f"only SQL: {r}" for r in list((y - x))[:3]]]
