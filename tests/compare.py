"""Run registered queries on Spark and their oracles on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, folder: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = query(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if got == want:
        return None
    missing = [r for r in want if r not in got][:2] if len(want) < 20000 else []
    extra = [r for r in got if r not in want][:2] if len(got) < 20000 else []
    return f"rows {len(got)} / {len(want)}; only oracle {str(missing)[:700]}; only Spark {str(extra)[:700]}"
