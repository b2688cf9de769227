"""Runs registered queries beside their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def canonical(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return repr(v + 0.0)
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark_df, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when equal, else what differs."""
    names = spark_df.columns
    mine = canonical([tuple(r) for r in spark_df.collect()], names)
    result = connection.execute(sql)
    their_names = [d[0] for d in result.description]
    if sorted(names) != sorted(their_names):
        return f"columns {sorted(names)} != {sorted(their_names)}"
    theirs = canonical(result.fetchall(), their_names)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} of {len(mine)} rows differ, e.g. {wrong[0]}" if wrong else ""
