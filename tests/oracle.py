"""Runs queries beside the SQL that states their results, and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pandas as pd


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def by_sql(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(folder).iterdir():
        if path.name.endswith(".parquet"):
            source = f"{path}/*.parquet" if path.is_dir() else str(path)
            con.execute(f"create view {path.name.removesuffix('.parquet')} as from read_parquet('{source}')")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return columns, got.fetchall()


def differences(spark, folder: str, query, sql: str) -> str:
    """Empty if both agree."""
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    columns, rows = by_sql(folder, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    other = rows_of(columns, rows)
    if mine == other:
        return ""
    only = [r for r in mine if r not in set(other)][:3], [r for r in other if r not in set(mine)][:3]
    return f"{len(mine)} rows against {len(other)}; only here {only[0]}; only there {only[1]}"[:1500]
