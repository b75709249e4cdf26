"""Side-by-side comparison of registered queries with their SQL."""

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _kind(series: pd.Series) -> str:
    if pd.api.types.is_integer_dtype(series):
        return "int"
    if pd.api.types.is_float_dtype(series):
        return "float"
    return "text"


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NA:
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def _rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)]
    rows = [tuple(_plain(v) for v in row) for row in ordered.astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """First difference found, or None when the results are equal."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} / {len(sql_frame)}"
    kinds = {c: (_kind(spark_frame[c]), _kind(sql_frame[c])) for c in spark_frame.columns if len(spark_frame)}
    unequal = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if unequal:
        return f"types {unequal}"
    for mine, theirs in zip(_rows(spark_frame), _rows(sql_frame)):
        if mine != theirs:
            return f"values {mine} / {theirs}"
    return None
