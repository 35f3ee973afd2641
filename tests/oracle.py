"""Runs a query next to its SQL and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return repr(value)


def difference(frame, con, sql: str) -> str | None:
    """None when both give the same columns, types and rows; else a short description."""
    expected = con.execute(sql)
    names = [column[0] for column in expected.description]
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} <> {sorted(names)}"
    order = sorted(names)
    found = sorted(tuple(_cell(row[name]) for name in order) for row in frame.collect())
    place = [names.index(name) for name in order]
    wanted = sorted(tuple(_cell(row[i]) for i in place) for row in expected.fetchall())
    if found == wanted:
        return None
    extra = [row for row in found if row not in set(wanted)][:3]
    lacking = [row for row in wanted if row not in set(found)][:3]
    return f"{len(found)} <> {len(wanted)} rows; only in Spark {extra}; only in SQL {lacking}"
