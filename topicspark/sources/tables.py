"""Topic log made from the star-schema test tables, for runs without a broker.

Every topic takes a number from its row's ID: ``partition = id % 4`` and ``offset = id div 4``.  So a record's
place needs no shuffle, and offsets may have gaps, as they do on a compacted or transactional topic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = 4

# Columns read from each table.  Named here, so that declaring a log opens no file.
SCHEMAS = {
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ,"
        " o_orderpriority STRING"
    ),
    "lineitem": "l_orderkey BIGINT, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "documents": "doc_id BIGINT, text STRING",
    "pages": "page_id BIGINT, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def millis(ntz: str) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ column, read as UTC whatever the session's zone is."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ntz})")


def _record(df: DataFrame, topic: Column, number: str, at_ms: Column, key: str, value: Column) -> DataFrame:
    return df.select(
        topic.alias("topic"),
        F.expr(f"CAST(pmod({number}, {PARTITIONS}) AS INT)").alias("partition"),
        F.expr(f"{number} div {PARTITIONS}").alias("offset"),
        F.timestamp_millis(at_ms).alias("timestamp"),
        F.col(key).cast("string").alias("key"),
        value.alias("value"),
    )


def _json(*fields: str) -> Column:
    return F.to_json(F.struct(*[F.expr(field) for field in fields]))


def _events(table: Callable[[str], DataFrame], topics: Sequence[str]) -> DataFrame:
    kinds = [topic.rsplit(".", 1)[1] for topic in topics]
    body = _json("event_id AS id", "user_id", "event_type", "value", "from_json(props, 'k INT') AS props")
    rows = table("events").filter(F.col("event_type").isin(kinds))
    return _record(rows, F.concat(F.lit("web.events."), "event_type"), "event_id", millis("ts"), "user_id", body)


def _errors(table, topics) -> DataFrame:
    # Truncated JSON: the prefix looks right, the parse fails.
    body = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "user": "'))
    rows = table("events").filter("event_type = 'error'")
    return _record(rows, F.lit("web.errors.dlt"), "event_id", millis("ts"), "user_id", body)


def _placed(table, topics) -> DataFrame:
    body = _json(
        "o_orderkey AS id",
        "o_custkey AS customer_id",
        "o_orderstatus AS status",
        "o_orderpriority AS priority",
        "o_totalprice AS amount",
    )
    return _record(
        table("orders"), F.lit("shop.orders.1.placed"), "o_orderkey", millis("o_orderdate"), "o_orderkey", body
    )


def _lines(table, topics) -> DataFrame:
    # Both topics come from one aggregate; an order without a closed line has no closing record.
    orders = table("lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("shipped"),
        F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("closed"),
        F.count("*").alias("lines"),
    )
    is_shipped = F.col("topic") == "shop.orders.2.shipped"
    steps = F.explode(F.array(*[F.lit(topic) for topic in topics]))
    rows = orders.withColumn("topic", steps).withColumn("at", F.when(is_shipped, F.col("shipped")).otherwise(F.col("closed")))
    body = F.when(is_shipped, _json("l_orderkey AS id", "lines")).otherwise(_json("l_orderkey AS id"))
    return _record(rows.filter("at IS NOT NULL"), F.col("topic"), "l_orderkey", millis("at"), "l_orderkey", body)


def _customers(table, topics) -> DataFrame:
    body = _json("c_custkey AS customer_id", "c_name AS name", "c_mktsegment AS segment", "c_nationkey AS nation")
    return _record(
        table("customer"), F.lit("shop.customers"), "c_custkey", F.lit(788832000000), "c_custkey", body
    )


def _orders_xml(table, topics) -> DataFrame:
    body = F.concat(
        F.lit('<Order id="'),
        F.col("o_orderkey").cast("string"),
        F.lit('"><Customer>'),
        F.col("o_custkey").cast("string"),
        F.lit("</Customer><Status>"),
        F.col("o_orderstatus"),
        F.lit("</Status><Days>"),
        F.floor(millis("o_orderdate") / 86400000).cast("string"),
        F.lit("</Days></Order>"),
    )
    return _record(
        table("orders"), F.lit("shop.orders.xml"), "o_orderkey", millis("o_orderdate"), "o_orderkey", body
    )


def _documents(table, topics) -> DataFrame:
    return _record(
        table("documents"), F.lit("raw.documents"), "doc_id", F.lit(1704067200000), "doc_id", F.col("text")
    )


def _pages(table, topics) -> DataFrame:
    return _record(table("pages"), F.lit("raw.pages"), "page_id", F.lit(1704067200000), "page_id", F.col("html"))


def _turns(table, topics) -> DataFrame:
    rows = table("conversations").withColumn("number", F.expr("(conv_id div 4) * 4000 + turn * 4 + conv_id % 4"))
    at_ms = F.lit(1704067200000) + F.col("conv_id") * 3600000 + F.col("turn") * 60000
    return _record(rows, F.lit("chat.turns"), "number", at_ms, "conv_id", _json("conv_id", "turn", "role", "text"))


_TOPICS: dict[str, Callable] = {
    **{f"web.events.{kind}": _events for kind in EVENT_TYPES},
    "web.errors.dlt": _errors,
    "shop.orders.1.placed": _placed,
    "shop.orders.2.shipped": _lines,
    "shop.orders.3.closed": _lines,
    "shop.customers": _customers,
    "shop.orders.xml": _orders_xml,
    "raw.documents": _documents,
    "raw.pages": _pages,
    "chat.turns": _turns,
}
TOPICS = tuple(_TOPICS)


def table_log(
    spark: SparkSession, sf_dir: str, topics: Sequence[str] | None = None, streaming: bool = False
) -> DataFrame:
    """Topic log over the tables in ``sf_dir``; only the tables behind ``topics`` are scanned.

    ``streaming`` reads the tables as file streams, for the topics made without an aggregation.
    """
    wanted = list(topics) if topics is not None else list(TOPICS)
    builders: dict[Callable, list[str]] = {}
    for topic in wanted:
        builders.setdefault(_TOPICS[topic], []).append(topic)

    def table(name: str) -> DataFrame:
        if streaming:
            reader = spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet")
            return reader.parquet(sf_dir)
        return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    return reduce(DataFrame.unionByName, [build(table, names) for build, names in builders.items()])
