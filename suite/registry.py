"""Queries over the test tables, each with the SQL that gives the same rows from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def ms(name: str, alias: str | None = None) -> Column:
    """A timestamp as epoch milliseconds: a number compares the same in every engine."""
    return F.unix_millis(name).alias(alias or name)


WEB = tuple(f"web.events.{kind}" for kind in ("click", "error", "purchase", "signup", "view"))
STEPS = ("shop.orders.1.placed", "shop.orders.2.shipped", "shop.orders.3.closed")


def _numbered(topic: str, number: str, at_ms: str, key: str, rest: str) -> str:
    return (
        f"SELECT {topic} AS topic, CAST({number} % 4 AS INTEGER) AS part, {number} // 4 AS off,"
        f" CAST({at_ms} AS BIGINT) AS ts_ms, CAST({key} AS VARCHAR) AS key {rest}"
    )


def _at(column: str) -> str:
    return f"epoch_us({column}) // 1000"


# The topic log as SQL, without values: place, time and key of every record.
LOG_PARTS = {
    "web": _numbered("'web.events.' || event_type", "event_id", _at("ts"), "user_id", "FROM events"),
    "dlt": _numbered("'web.errors.dlt'", "event_id", _at("ts"), "user_id", "FROM events WHERE event_type = 'error'"),
    "placed": _numbered("'shop.orders.1.placed'", "o_orderkey", _at("o_orderdate"), "o_orderkey", "FROM orders"),
    "shipped": _numbered(
        "'shop.orders.2.shipped'", "l_orderkey", _at("min(l_shipdate)"), "l_orderkey", "FROM lineitem GROUP BY l_orderkey"
    ),
    "closed": _numbered(
        "'shop.orders.3.closed'", "l_orderkey", _at("max(l_shipdate)"), "l_orderkey",
        "FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey",
    ),
    "customers": _numbered("'shop.customers'", "c_custkey", "788832000000", "c_custkey", "FROM customer"),
    "xml": _numbered("'shop.orders.xml'", "o_orderkey", _at("o_orderdate"), "o_orderkey", "FROM orders"),
    "documents": _numbered("'raw.documents'", "doc_id", "1704067200000", "doc_id", "FROM documents"),
    "pages": _numbered("'raw.pages'", "page_id", "1704067200000", "page_id", "FROM pages"),
    "turns": _numbered(
        "'chat.turns'", "((conv_id // 4) * 4000 + turn * 4 + conv_id % 4)",
        "1704067200000 + conv_id * 3600000 + turn * 60000", "conv_id", "FROM conversations",
    ),
}


def log_cte(*parts: str) -> str:
    """``WITH log AS (..)`` over the named parts, or over all of them."""
    chosen = [LOG_PARTS[part] for part in (parts or LOG_PARTS)]
    return "WITH log AS (" + " UNION ALL ".join(chosen) + ")"
