"""A Spark result against DuckDB's for the same tables."""

from __future__ import annotations

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def views(folder: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def shown(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def lines(rows) -> list[str]:
    return sorted("|".join(map(shown, r)) for r in rows)


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    columns = sorted(df.columns)
    got = lines(tuple(r[c] for c in columns) for r in df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == lines(tuple(r[i] for i in at) for r in found.fetchall())
