"""Compare a Spark result with the same query in DuckDB, value by value."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from gridlens.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", float(v))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        return ("float", "nan" if math.isnan(v) else v + 0.0)
    if isinstance(v, datetime.datetime):
        return ("time", v.isoformat())
    if v is None:
        return ("null", "")
    return (type(v).__name__, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(table, key=repr)


def differences(spark_df, con, sql) -> list[str]:
    cursor = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = []
    if got_names != want_names:
        found.append(f"columns {got_names} != {want_names}")
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        found.append(f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}")
    return found
