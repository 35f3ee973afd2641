"""Scans, catalog, schema inference, and values inside messages."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

import topicspark as ts
from suite.registry import STEPS, WEB, case, log_cte, ms
from topicspark.sources.tables import table_log

PLACE = ("topic", "partition", "offset")
PLACE_SQL = 'topic, part AS "partition", off AS "offset"'
SIZES = """, sizes AS (SELECT topic, CAST(sum(n) AS BIGINT) AS messages FROM
 (SELECT topic, part, max(off) + 1 - min(off) AS n FROM log GROUP BY topic, part) GROUP BY topic)"""
STATE = """CASE WHEN messages = 0 THEN 'Empty' WHEN lower(topic) LIKE '%.dlt' THEN 'DLT' ELSE 'Healthy' END AS state"""


@case("topic_stats", log_cte() + SIZES + " SELECT topic, messages FROM sizes")
def topic_stats(spark, sf_dir):
    return ts.topic_stats(table_log(spark, sf_dir))


@case(
    "topic_descriptor",
    log_cte()
    + """, ends AS (SELECT topic, part, min(off) AS lo, max(off) + 1 AS hi FROM log GROUP BY topic, part)
    SELECT topic, CAST(count(*) OVER (PARTITION BY topic) AS INTEGER) AS partitions, part AS "partition", lo AS min_offset,
      hi AS max_offset, 'AUTO' AS format, CAST(sum(hi - lo) OVER (PARTITION BY topic) AS BIGINT) AS estimated_size
    FROM ends""",
)
def topic_descriptor(spark, sf_dir):
    described = ts.topic_descriptor(table_log(spark, sf_dir))
    return described.select(
        "*", F.explode("min_offsets").alias("partition", "min_offset")
    ).select(
        "topic", "partitions", "partition", "min_offset",
        F.col("max_offsets")[F.col("partition")].alias("max_offset"), "format", "estimated_size",
    )


@case(
    "tail_records",
    log_cte()
    + f""" SELECT {PLACE_SQL}, ts_ms AS timestamp FROM log
    QUALIFY row_number() OVER (PARTITION BY topic ORDER BY ts_ms DESC, part, off DESC) <= 25""",
)
def tail_records(spark, sf_dir):
    return ts.tail_records(table_log(spark, sf_dir), 25).select(*PLACE, ms("timestamp"))


@case(
    "tail_offsets",
    log_cte("web", "placed")
    + """, starts AS (SELECT topic, part, greatest(0, max(off) + 1 - 100) AS start FROM log GROUP BY topic, part),
    topics AS (SELECT topic, string_agg('"' || part || '":' || start, ',' ORDER BY part) AS ends FROM starts GROUP BY topic)
    SELECT '{' || string_agg('"' || topic || '":{' || ends || '}', ',' ORDER BY topic) || '}' AS starting_offsets
    FROM topics""",
)
def tail_offsets(spark, sf_dir):
    return ts.tail_offsets(table_log(spark, sf_dir, [*WEB, "shop.orders.1.placed"]), 100)


@case(
    "records_since",
    log_cte("web")
    + f""" SELECT {PLACE_SQL}, ts_ms AS timestamp FROM log
    WHERE ts_ms >= epoch_us(TIMESTAMP '2024-01-31 00:00:00') // 1000 - 14400 * 60000
    QUALIFY row_number() OVER (PARTITION BY topic ORDER BY ts_ms, part, off) <= 200""",
)
def records_since(spark, sf_dir):
    end = datetime(2024, 1, 31, tzinfo=timezone.utc)
    return ts.records_since(table_log(spark, sf_dir, WEB), 14400, 200, end).select(*PLACE, ms("timestamp"))


@case(
    "head_sample",
    log_cte()
    + f""" SELECT {PLACE_SQL} FROM log WHERE part = 0
    QUALIFY row_number() OVER (PARTITION BY topic ORDER BY off) <= 10""",
)
def head_sample(spark, sf_dir):
    return ts.head_sample(table_log(spark, sf_dir)).select(*PLACE)


@case(
    "sample_messages",
    """WITH d AS (SELECT doc_id, text FROM documents
      QUALIFY row_number() OVER (ORDER BY doc_id % 4, doc_id // 4 DESC) <= 20),
    p AS (SELECT page_id, html FROM pages QUALIFY row_number() OVER (ORDER BY page_id % 4, page_id // 4 DESC) <= 20)
    SELECT 'raw.documents' AS topic, CAST(doc_id AS VARCHAR) AS key, text AS value FROM d WHERE text IS NOT NULL
    UNION ALL SELECT 'raw.pages', CAST(page_id AS VARCHAR), html FROM p WHERE html IS NOT NULL""",
)
def sample_messages(spark, sf_dir):
    return ts.sample_messages(table_log(spark, sf_dir, ["raw.documents", "raw.pages"]), 20).select("topic", "key", "value")


@case(
    "table_preview",
    """SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status FROM orders
    ORDER BY o_orderkey % 4, o_orderkey // 4 LIMIT 10""",
)
def table_preview(spark, sf_dir):
    return ts.preview(_typed(spark, sf_dir, keep=("partition", "offset"))).select("id", "customer_id", "status")


@case("filter_prefix", log_cte() + SIZES + f" SELECT topic, messages, {STATE} FROM sizes WHERE topic LIKE 'web.%'")
def filter_prefix(spark, sf_dir):
    return ts.filter_topics(ts.topic_stats(table_log(spark, sf_dir)), prefix="web.")


@case("filter_name", log_cte() + SIZES + f" SELECT topic, messages, {STATE} FROM sizes WHERE topic = 'chat.turns'")
def filter_name(spark, sf_dir):
    return ts.filter_topics(ts.topic_stats(table_log(spark, sf_dir)), name="chat.turns")


@case(
    "filter_contains",
    log_cte() + SIZES + f" SELECT topic, messages, {STATE} FROM sizes WHERE contains(lower(topic), 'orders')",
)
def filter_contains(spark, sf_dir):
    return ts.filter_topics(ts.topic_stats(table_log(spark, sf_dir)), contains="ORDERS")


@case(
    "filter_dead_letters",
    log_cte() + SIZES + f" SELECT topic, messages, {STATE} FROM sizes WHERE topic NOT LIKE '%.dlt' AND messages > 0",
)
def filter_dead_letters(spark, sf_dir):
    return ts.filter_topics(ts.topic_stats(table_log(spark, sf_dir)), hide_dlt=True, non_empty=True)


@case("topic_states", log_cte() + SIZES + f", named AS (SELECT * FROM sizes UNION ALL SELECT 'no.such', 0) SELECT topic, messages, {STATE} FROM named")
def topic_states(spark, sf_dir):
    log = table_log(spark, sf_dir)
    names = log.select("topic").distinct().union(spark.createDataFrame([("no.such",)], "topic STRING"))
    return ts.filter_topics(ts.topic_stats(log, names))


FORMATS = """, formats AS (SELECT topic, CASE WHEN topic IN ('shop.orders.xml', 'raw.pages') THEN 'XML'
   WHEN topic = 'raw.documents' THEN coalesce((SELECT CASE WHEN regexp_matches(text, '^\\s*<') THEN 'XML' ELSE 'JSON' END
     FROM (SELECT doc_id, text FROM documents WHERE doc_id % 4 = 0 ORDER BY doc_id LIMIT 10)
     WHERE regexp_matches(text, '^\\s*[\\[{<]') ORDER BY doc_id LIMIT 1), 'AUTO')
   ELSE 'JSON' END AS format FROM (SELECT DISTINCT topic FROM log))"""


@case("detect_format", log_cte() + FORMATS + " SELECT topic, format FROM formats")
def detect_format(spark, sf_dir):
    return ts.detect_format(table_log(spark, sf_dir))


# What the topics' values are made of, column by column.
COLUMNS = """, columns(base, ordinal, name, type) AS (VALUES
  ('web.events', 0, 'id', 'BIGINT'), ('web.events', 1, 'user_id', 'BIGINT'), ('web.events', 2, 'event_type', 'STRING'),
  ('web.events', 3, 'value', 'DOUBLE'), ('web.events', 4, 'props', 'STRING'),
  ('shop.orders.1.placed', 0, 'id', 'BIGINT'), ('shop.orders.1.placed', 1, 'customer_id', 'BIGINT'),
  ('shop.orders.1.placed', 2, 'status', 'STRING'), ('shop.orders.1.placed', 3, 'priority', 'STRING'),
  ('shop.orders.1.placed', 4, 'amount', 'DOUBLE'),
  ('shop.orders.2.shipped', 0, 'id', 'BIGINT'), ('shop.orders.2.shipped', 1, 'lines', 'BIGINT'),
  ('shop.orders.3.closed', 0, 'id', 'BIGINT'),
  ('shop.customers', 0, 'customer_id', 'BIGINT'), ('shop.customers', 1, 'name', 'STRING'),
  ('shop.customers', 2, 'segment', 'STRING'), ('shop.customers', 3, 'nation', 'BIGINT'),
  ('shop.orders.xml', 0, 'Customer', 'STRING'), ('shop.orders.xml', 1, 'Status', 'STRING'),
  ('shop.orders.xml', 2, 'Days', 'STRING'),
  ('chat.turns', 0, 'conv_id', 'BIGINT'), ('chat.turns', 1, 'turn', 'BIGINT'), ('chat.turns', 2, 'role', 'STRING'),
  ('chat.turns', 3, 'text', 'STRING')),
  inferred AS (SELECT topic, CAST(ordinal AS INTEGER) AS ordinal, name AS "column", type FROM columns
    JOIN (SELECT DISTINCT topic, CASE WHEN topic LIKE 'web.events.%' THEN 'web.events' ELSE topic END AS base FROM log)
    USING (base))"""


@case("infer_schema", log_cte() + COLUMNS + ' SELECT topic, ordinal, "column", type FROM inferred')
def infer_schema(spark, sf_dir):
    return ts.infer_schema(table_log(spark, sf_dir))


@case(
    "infer_schema_whole",
    log_cte("web", "placed") + COLUMNS + ' SELECT topic, ordinal, "column", type FROM inferred',
)
def infer_schema_whole(spark, sf_dir):
    return ts.infer_schema(table_log(spark, sf_dir, [*WEB, "shop.orders.1.placed"]), n=None)


@case(
    "find_key_field",
    log_cte()
    + COLUMNS
    + """ SELECT topic, "column" AS key_field, type AS key_type FROM inferred
    QUALIFY row_number() OVER (PARTITION BY topic ORDER BY ("column" <> 'id'),
      (lower("column") NOT IN ('id', 'order_id')), ordinal) = 1""",
)
def find_key_field(spark, sf_dir):
    return ts.find_key_field(ts.infer_schema(table_log(spark, sf_dir)))


def _typed(spark, sf_dir, topic="shop.orders.1.placed", keep=(), rows=None):
    """Typed view of one topic, with the columns inferred from its own samples."""
    log = table_log(spark, sf_dir, [topic])
    return ts.topic_table(log, ts.schema_struct(ts.infer_schema(log), topic), keep=keep)


@case(
    "typed_view",
    """SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status, o_orderpriority AS priority,
    o_totalprice AS amount, epoch_us(o_orderdate) // 1000 AS event_time FROM orders""",
)
def typed_view(spark, sf_dir):
    return _typed(spark, sf_dir).select("id", "customer_id", "status", "priority", "amount", ms("event_time"))


@case(
    "typed_view_bad_rows",
    """SELECT CAST(user_id AS VARCHAR) AS key, CAST(NULL AS BIGINT) AS id, '{"id": ' || event_id || ', "user": "' AS raw_value
    FROM events WHERE event_type = 'error'""",
)
def typed_view_bad_rows(spark, sf_dir):
    # Truncated messages under the schema they should have: the row stays, its columns are null, the raw value is kept.
    sound = ts.infer_schema(table_log(spark, sf_dir, ["web.events.error"]))
    broken = table_log(spark, sf_dir, ["web.errors.dlt"])
    view = ts.topic_table(broken, ts.schema_struct(sound, "web.events.error"), keep=("key",))
    return view.select("key", "id", "raw_value")


@case(
    "json_value_filter",
    """SELECT event_id AS id, event_type, CAST(CAST(props ->> '$.k' AS INTEGER) AS VARCHAR) AS k FROM events
    WHERE CAST(props ->> '$.k' AS INTEGER) > 95""",
)
def json_value_filter(spark, sf_dir):
    log = table_log(spark, sf_dir, WEB)
    k = ts.json_value("value", "$.props.k")
    return log.filter(k.try_cast("double") > 95).select(
        ts.json_value("value", "$.id").cast("bigint").alias("id"),
        ts.json_value("value", "$.event_type").alias("event_type"),
        k.alias("k"),
    )


@case(
    "json_value_kinds",
    """SELECT count(*) AS messages, CAST(0 AS BIGINT) AS objects, CAST(0 AS BIGINT) AS missing, count(event_type) AS scalars
    FROM events""",
)
def json_value_kinds(spark, sf_dir):
    log = table_log(spark, sf_dir, WEB)
    return log.agg(
        F.count("*").alias("messages"),
        F.count(ts.json_value("value", "$.props")).alias("objects"),
        F.count(ts.json_value("value", "$.nothing.here")).alias("missing"),
        F.count(ts.json_value("value", "$.event_type")).alias("scalars"),
    )


@case(
    "xml_extract",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status,
    CAST(NULL AS VARCHAR) AS missing FROM orders""",
)
def xml_extract(spark, sf_dir):
    log = table_log(spark, sf_dir, ["shop.orders.xml"])
    paths = {"id": "/Order/@id", "customer": "/Order/Customer", "status": "/Order/Status", "missing": "/Order/Nothing"}
    return log.select(ts.xml_extract_all("value", paths).alias("x")).select("x.*")


@case(
    "sql_xml_extract",
    """SELECT CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status FROM orders
    WHERE epoch_us(o_orderdate) // 86400000000 > 11000""",
)
def sql_xml_extract(spark, sf_dir):
    sql = """SELECT XmlExtract(value, '/Order/Customer') AS customer, XmlExtract(value, '//Status') AS status FROM {topic}
    WHERE XmlExtract(value, '/Order/Days') > 11000"""
    return ts.run_template(spark, sql, table_log(spark, sf_dir, ["shop.orders.xml"]))


@case(
    "sql_json_value",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type, CAST(CAST(props ->> '$.k' AS INTEGER) AS VARCHAR) AS k,
    CAST(NULL AS VARCHAR) AS whole FROM events WHERE CAST(props ->> '$.k' AS INTEGER) > 95""",
)
def sql_json_value(spark, sf_dir):
    sql = """SELECT JSON_VALUE(value, '$.id') AS id, JSON_VALUE(value, '$.event_type') AS event_type,
    JSON_VALUE(value, '$.props.k') AS k, JSON_VALUE(value, '$.props') AS whole FROM {topic}
    WHERE JSON_VALUE(value, '$.props.k') > 95"""
    return ts.run_template(spark, sql, table_log(spark, sf_dir, WEB))


@case(
    "xml_extract_errors",
    "SELECT 'Error: malformed XML' AS title, count(*) AS pages FROM pages WHERE html LIKE '<!DOCTYPE%'",
)
def xml_extract_errors(spark, sf_dir):
    log = table_log(spark, sf_dir, ["raw.pages"])
    return log.groupBy(ts.xml_extract("value", "/html/head/title").alias("title")).agg(F.count("*").alias("pages"))


@case(
    "xml_filter",
    """SELECT CAST(o_custkey AS VARCHAR) AS customer, CAST(epoch_us(o_orderdate) // 86400000000 AS VARCHAR) AS days
    FROM orders WHERE epoch_us(o_orderdate) // 86400000000 > 11000""",
)
def xml_filter(spark, sf_dir):
    log = table_log(spark, sf_dir, ["shop.orders.xml"])
    extracted = log.select(
        ts.xml_extract("value", "/Order/Customer").alias("customer"), ts.xml_extract("value", "/Order/Days").alias("days")
    )
    return ts.run_sql(
        spark, "SELECT customer, days FROM {topic} WHERE try_cast(days AS DOUBLE) > 11000", None, topic=extracted
    )


@case(
    "join_reference",
    """SELECT c_name AS name, c_mktsegment AS segment, o_totalprice AS amount, o_orderstatus AS status
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_reference(spark, sf_dir):
    return ts.run_sql(
        spark,
        "SELECT c.name, c.segment, o.amount, o.status FROM {orders} o JOIN {customers} c ON o.customer_id = c.customer_id",
        None,
        orders=_typed(spark, sf_dir),
        customers=_typed(spark, sf_dir, "shop.customers"),
    )


@case(
    "run_template",
    """SELECT 'placed' AS side, o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS at FROM orders
      WHERE o_orderdate >= TIMESTAMP '1996-01-01'
    UNION ALL SELECT 'shipped', l_orderkey, epoch_us(min(l_shipdate)) // 1000 FROM lineitem GROUP BY l_orderkey
      HAVING min(l_shipdate) >= TIMESTAMP '1996-01-01'""",
)
def run_template(spark, sf_dir):
    # One text and one time range for both topics.
    text = """SELECT :side AS side, id, unix_millis(event_time) AS at FROM {topic}
    WHERE event_time >= timestamp_millis(:start)"""
    placed, shipped = (_typed(spark, sf_dir, topic) for topic in STEPS[:2])
    return ts.run_template(spark, text, placed, {"side": "placed", "start": 820454400000}).union(
        ts.run_template(spark, text, shipped, {"side": "shipped", "start": 820454400000})
    )


@case(
    "time_range",
    """SELECT event_type, count(*) AS messages FROM events
    WHERE epoch_us(ts) // 1000 >= epoch_us(TIMESTAMP '2024-01-10') // 1000
      AND epoch_us(ts) // 1000 < epoch_us(TIMESTAMP '2024-01-20') // 1000 GROUP BY event_type""",
)
def time_range(spark, sf_dir):
    return ts.run_sql(
        spark,
        """SELECT event_type, count(*) AS messages FROM {topic}
        WHERE event_time >= timestamp_millis(1704844800000) AND event_time < timestamp_millis(1705708800000)
        GROUP BY event_type""",
        None,
        topic=ts.topic_table(
            table_log(spark, sf_dir, WEB), ts.schema_struct(ts.infer_schema(table_log(spark, sf_dir, WEB[:1])), WEB[0])
        ),
    )


@case(
    "topic_detail",
    log_cte("web", "xml", "customers")
    + SIZES
    + COLUMNS
    + """ SELECT topic, messages AS estimated_size, CASE WHEN topic = 'shop.orders.xml' THEN 'XML' ELSE 'JSON' END AS format,
      (SELECT string_agg(i."column" || ' ' || i.type, ', ' ORDER BY i.ordinal) FROM inferred i WHERE i.topic = sizes.topic)
        AS columns,
      (SELECT CAST(max(l.ts_ms) AS BIGINT) FROM log l WHERE l.topic = sizes.topic) AS newest,
      CAST(20 AS INTEGER) AS samples FROM sizes""",
)
def topic_detail(spark, sf_dir):
    detail = ts.topic_detail(table_log(spark, sf_dir, [*WEB, "shop.orders.xml", "shop.customers"]))
    return detail.select(
        "topic",
        "estimated_size",
        "format",
        F.array_join(F.transform("columns", lambda c: F.concat(c["column"], F.lit(" "), c["type"])), ", ").alias("columns"),
        F.unix_millis(F.col("samples")[0]["timestamp"]).alias("newest"),
        F.size("samples").alias("samples"),
    )


@case(
    "dashboard",
    log_cte()
    + SIZES
    + """ SELECT count(*) AS topics, CAST(sum(messages) AS BIGINT) AS messages,
      count(*) FILTER (topic NOT LIKE '%.dlt' AND messages > 0) AS healthy, count(*) FILTER (messages = 0) AS empty,
      count(*) FILTER (topic LIKE '%.dlt' AND messages > 0) AS dead_letter FROM sizes""",
)
def dashboard(spark, sf_dir):
    return ts.dashboard(table_log(spark, sf_dir))
