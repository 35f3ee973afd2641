"""Audit, flows, tracing, comparison, metrics and lineage."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

import topicspark as ts
from suite.registry import STEPS, WEB, case, log_cte, ms
from suite.scans import COLUMNS, FORMATS, SIZES, _typed
from topicspark.operators.shared import checkpoint_root, checkpointed
from topicspark.sources.tables import table_log

COUNTS = ", counts AS (SELECT topic, count(*) AS message_count FROM log GROUP BY topic)"
# Key columns of these tables are unique but for the conversations', whose key repeats with every turn.
REPEATS = """, repeats AS (SELECT topic, CASE WHEN topic = 'chat.turns' THEN
   (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1)) ELSE 0 END
   AS duplicate_count FROM counts)"""

# Error records are cut off in the middle, and raw pages are HTML: neither parses as what it looks like.
POISON = """, poison AS (SELECT topic, CASE WHEN topic IN ('web.errors.dlt', 'raw.pages') THEN message_count ELSE 0 END
   AS poison_count FROM counts)"""


@case("exact_counts", log_cte() + COUNTS + " SELECT topic, message_count FROM counts")
def exact_counts(spark, sf_dir):
    return ts.exact_counts(table_log(spark, sf_dir))


@case(
    "duplicate_keys",
    """SELECT 'web.events.' || event_type AS topic, count(*) AS duplicate_count FROM
      (SELECT event_type, user_id FROM events GROUP BY event_type, user_id HAVING count(*) > 1) GROUP BY event_type
    UNION ALL SELECT 'chat.turns', count(*) FROM (SELECT role FROM conversations GROUP BY role HAVING count(*) > 1)
    UNION ALL SELECT 'shop.customers', 0""",
)
def duplicate_keys(spark, sf_dir):
    log = table_log(spark, sf_dir, [*WEB, "chat.turns", "shop.customers"])
    return ts.duplicate_keys(log, {**{topic: "user_id" for topic in WEB}, "chat.turns": "role"})


@case(
    "poison_prefix",
    log_cte()
    + """ SELECT topic, CASE WHEN topic IN ('raw.documents', 'raw.pages', 'shop.orders.xml') THEN count(*) ELSE 0 END
      AS poison_count FROM log GROUP BY topic""",
)
def poison_prefix(spark, sf_dir):
    log = table_log(spark, sf_dir)
    # Every topic declared JSON: whatever does not start like JSON contradicts that.
    return ts.poison_counts(log, log.select("topic", F.lit("JSON").alias("format")).distinct(), mode="prefix")


@case(
    "poison_sample",
    log_cte()
    + """ SELECT topic, CASE WHEN topic IN ('raw.documents', 'raw.pages', 'shop.orders.xml') THEN least(10, count(*))
      ELSE 0 END AS poison_count FROM log GROUP BY topic""",
)
def poison_sample(spark, sf_dir):
    log = table_log(spark, sf_dir)
    return ts.poison_counts(log, log.select("topic", F.lit("JSON").alias("format")).distinct(), mode="prefix", n=10)


@case(
    "poison_parse",
    log_cte()
    + """ SELECT topic, count(*) FILTER (topic = 'web.errors.dlt' OR topic = 'raw.pages') AS poison_count
    FROM log GROUP BY topic""",
)
def poison_parse(spark, sf_dir):
    log = table_log(spark, sf_dir)
    return ts.poison_counts(log, ts.detect_format(log))


AUDIT = (
    log_cte()
    + FORMATS
    + COUNTS
    + REPEATS
    + POISON
    + """ SELECT topic, message_count, format, poison_count, duplicate_count,
      CASE WHEN duplicate_count + poison_count > 0 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS health,
      concat_ws('|', CASE WHEN poison_count > 0 THEN 'Detected ' || poison_count || ' malformed messages in sample.' END,
        CASE WHEN duplicate_count > 0 THEN 'Detected ' || duplicate_count || ' potential duplicate records.' END)
        AS issues
    FROM counts JOIN formats USING (topic) JOIN repeats USING (topic) JOIN poison USING (topic)"""
)


@case("topic_audit", AUDIT)
def topic_audit(spark, sf_dir):
    audit = ts.topic_audit(table_log(spark, sf_dir))
    return audit.withColumn("issues", F.array_join("issues", "|"))


@case("audit_from_parts", AUDIT)
def audit_from_parts(spark, sf_dir):
    """The audit from stored scans of two halves of the log: an added half costs its own scan only."""
    log = table_log(spark, sf_dir)
    halves = [ts.scan_values(log.filter(F.col("partition") % 2 == half)) for half in (0, 1)]
    audit = ts.topic_audit(log, parts=halves[0].unionByName(halves[1]))
    return audit.withColumn("issues", F.array_join("issues", "|"))


FLOWS = """, named AS (SELECT topic, message_count, split_part(topic, '.', 1) || '.' || split_part(topic, '.', 2) AS flow
   FROM counts WHERE contains(topic, '.')),
 grouped AS (SELECT * FROM named QUALIFY count(*) OVER (PARTITION BY flow) >= 2),
 steps AS (SELECT flow, CAST(row_number() OVER (PARTITION BY flow ORDER BY topic) AS INTEGER) AS ordinal, topic, message_count,
   CAST(message_count AS DOUBLE) / first_value(message_count) OVER (PARTITION BY flow ORDER BY topic) * 100.0
     AS throughput_pct,
   lag(message_count) OVER (PARTITION BY flow ORDER BY topic) - message_count AS drop_off FROM grouped),
 scored AS (SELECT *, last_value(throughput_pct) OVER (PARTITION BY flow ORDER BY ordinal
   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS health_score FROM steps)"""
STEP_COLUMNS = """flow, ordinal, topic, message_count, round(throughput_pct, 6) AS throughput_pct, drop_off"""


def _rounded(steps):
    return steps.withColumn("throughput_pct", F.round("throughput_pct", 6)).withColumn(
        "health_score", F.round("health_score", 6)
    )


@case(
    "flow_steps",
    log_cte() + COUNTS + FLOWS + f" SELECT {STEP_COLUMNS}, round(health_score, 6) AS health_score FROM scored",
)
def flow_steps(spark, sf_dir):
    return _rounded(ts.flow_steps(ts.exact_counts(table_log(spark, sf_dir))))


@case(
    "step_latency",
    log_cte()
    + COUNTS
    + FLOWS
    + """ SELECT b.flow, b.ordinal, b.topic, (SELECT CAST(sum(y.ts_ms - x.ts_ms) // count(*) AS BIGINT)
        FROM log x JOIN log y ON x.key = y.key AND y.ts_ms > x.ts_ms WHERE x.topic = a.topic AND y.topic = b.topic)
        AS avg_latency_ms
    FROM scored b LEFT JOIN scored a ON a.flow = b.flow AND a.ordinal + 1 = b.ordinal""",
)
def step_latency(spark, sf_dir):
    log = table_log(spark, sf_dir)
    return ts.step_latency(log, ts.flow_steps(ts.exact_counts(log)), key="key")


@case(
    "flow_audit",
    log_cte()
    + COUNTS
    + FLOWS
    + f""" SELECT {STEP_COLUMNS}, CASE topic
      WHEN 'shop.orders.2.shipped' THEN (SELECT CAST(sum(y.ts_ms - x.ts_ms) // count(*) AS BIGINT) FROM log x
        JOIN log y ON x.key = y.key AND y.ts_ms > x.ts_ms
        WHERE x.topic = 'shop.orders.1.placed' AND y.topic = 'shop.orders.2.shipped')
      WHEN 'shop.orders.3.closed' THEN (SELECT CAST(sum(y.ts_ms - x.ts_ms) // count(*) AS BIGINT) FROM log x
        JOIN log y ON x.key = y.key AND y.ts_ms > x.ts_ms
        WHERE x.topic = 'shop.orders.2.shipped' AND y.topic = 'shop.orders.3.closed')
      END AS avg_latency_ms, round(health_score, 6) AS health_score FROM scored""",
)
def flow_audit(spark, sf_dir):
    return _rounded(ts.flow_audit(table_log(spark, sf_dir)))


@case(
    "audit_report",
    log_cte()
    + COUNTS
    + REPEATS
    + POISON
    + FLOWS
    + SIZES
    + """ SELECT 'audit-1' AS audit_id, 'COMPLETED' AS status, count(*) AS total_topics,
      (SELECT CAST(sum(messages) AS BIGINT) FROM sizes) AS total_messages,
      count(*) FILTER (duplicate_count + poison_count > 0) AS unhealthy_topics, CAST(count(*) AS INTEGER) AS topics,
      (SELECT CAST(count(*) AS INTEGER) FROM scored) AS steps, CAST(sum(duplicate_count) AS BIGINT) AS duplicates,
      CAST(sum(poison_count) AS BIGINT) AS poison,
      (SELECT CAST(sum(message_count * ordinal) AS BIGINT) FROM scored) AS step_messages,
      (SELECT CAST(sum(y.ts_ms - x.ts_ms) // count(*) AS BIGINT) FROM log x JOIN log y ON x.key = y.key
        AND y.ts_ms > x.ts_ms WHERE x.topic = 'shop.orders.1.placed' AND y.topic = 'shop.orders.2.shipped') AS shipped_ms
      FROM repeats JOIN poison USING (topic)""",
)
def audit_report(spark, sf_dir):
    # The audit, its flows and the report share the sizes, one scan of the values, and the audit's rows.
    log = table_log(spark, sf_dir)
    sizes = checkpointed(ts.topic_stats(log))
    parts = ts.scan_values(log, moments=True)
    audit = checkpointed(ts.topic_audit(log, catalog=sizes, parts=parts))
    report = ts.audit_report(audit, ts.flow_audit(log, audit=audit, catalog=sizes, parts=parts), "audit-1", sizes)
    zero = F.lit(0).cast("bigint")

    def total(items, value):
        return F.aggregate(items, zero, lambda sum_, item: sum_ + value(item))

    shipped = F.filter("flow_steps", lambda s: s["topic"] == "shop.orders.2.shipped")
    return report.select(
        "audit_id", "status", "total_topics", "total_messages", "unhealthy_topics",
        F.size("topic_audits").alias("topics"), F.size("flow_steps").alias("steps"),
        total("topic_audits", lambda t: t["duplicate_count"]).alias("duplicates"),
        total("topic_audits", lambda t: t["poison_count"]).alias("poison"),
        total("flow_steps", lambda s: s["message_count"] * s["ordinal"]).alias("step_messages"),
        shipped[0]["avg_latency_ms"].alias("shipped_ms"),
    )


def _orders_as_log(spark, sf_dir, topic, key, value):
    """One record per order, keyed by customer: a log in which keys are written again and again."""
    placed = table_log(spark, sf_dir, ["shop.orders.1.placed"])
    rows = placed.select(
        "partition", "offset", "timestamp",
        F.from_json("value", "id BIGINT, customer_id BIGINT, status STRING, amount DOUBLE").alias("o"),
    )
    return rows.select(
        F.lit(topic).alias("topic"), "partition", "offset", "timestamp", key.alias("key"), F.to_json(value).alias("value")
    )


# Of each partition the record with the last offset; of these, should a key be in several, the latest.
LAST_ORDER = """WITH ends AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4
   ORDER BY o_orderkey // 4 DESC) = 1),
   last AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY o_custkey
   ORDER BY o_orderdate DESC, o_orderkey % 4 DESC) = 1) """


@case(
    "audit_history",
    LAST_ORDER
    + """SELECT 'audit-' || o_custkey AS audit_id, 'COMPLETED' AS status, o_orderkey % 50 AS total_topics,
      o_orderkey AS total_messages, o_orderkey % 3 AS unhealthy_topics, epoch_us(o_orderdate) // 1000 AS written_at,
      o_orderstatus AS topic, o_orderkey AS step_messages
    FROM last""",
)
def audit_history(spark, sf_dir):
    audit_id = F.concat(F.lit("audit-"), F.col("o.customer_id").cast("string"))
    record = F.struct(
        audit_id.alias("audit_id"),
        F.lit("COMPLETED").alias("status"),
        (F.col("o.id") % 50).alias("total_topics"),
        F.col("o.id").alias("total_messages"),
        (F.col("o.id") % 3).alias("unhealthy_topics"),
        F.array(F.struct(F.col("o.status").alias("name"))).alias("topic_audits"),
        F.array(F.struct(F.lit("f").alias("flow"), F.col("o.id").alias("message_count"))).alias("flow_steps"),
    )
    log = _orders_as_log(spark, sf_dir, "internal.audit.history", audit_id, record)
    return ts.audit_history(log).select(
        "audit_id", "status", "total_topics", "total_messages", "unhealthy_topics", ms("written_at"),
        F.col("topic_audits")[0]["name"].alias("topic"), F.col("flow_steps")[0]["message_count"].alias("step_messages"),
    )


@case(
    "log_sink",
    """SELECT 'copy.customers' AS topic, CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment
    FROM customer""",
)
def log_sink(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/log-{uuid.uuid4().hex}"
    customers = _typed(spark, sf_dir, "shop.customers").select("customer_id", "name", "segment")
    ts.write_log(customers, "customer_id", "copy.customers", path)
    log = ts.read_topic(spark, path, ["copy.customers"])
    return log.select(
        "topic", "key", F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.segment").alias("segment")
    )


@case(
    "log_sink_repeated",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(1 AS BIGINT) AS records, true AS dense FROM customer""",
)
def log_sink_repeated(spark, sf_dir):
    """Two batches, each written twice: every record is there once, and each partition's offsets have no gaps."""
    path = f"{checkpoint_root(spark)}/log-{uuid.uuid4().hex}"
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").repartition(3)
    for batch in (0, 1, 1, 0):
        some = customers.filter(F.col("c_custkey") % 2 == batch)
        ts.write_log(some, "c_custkey", "copy.customers", path, batch=f"copy-{batch}")
    log = ts.read_topic(spark, path)
    gaps = log.groupBy("partition").agg((F.max("offset") - F.min("offset") + 1 == F.count("*")).alias("dense"))
    return log.join(F.broadcast(gaps), "partition").groupBy("key").agg(F.count("*").alias("records"), F.bool_and("dense").alias("dense"))


@case(
    "log_sink_sizes",
    """SELECT 'copy.customers' AS topic, count(*) AS messages, count(*) AS records, CAST(4 AS BIGINT) AS partitions
    FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer)""",
)
def log_sink_sizes(spark, sf_dir):
    """Two writes of a table from several tasks: the size by offsets is the count."""
    path = f"{checkpoint_root(spark)}/log-{uuid.uuid4().hex}"
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").repartition(3)
    ts.write_log(customers, "c_custkey", "copy.customers", path)
    ts.write_log(customers, "c_custkey", "copy.customers", path)
    log = ts.read_topic(spark, path, ["copy.customers"])
    counted = log.groupBy("topic").agg(F.count("*").alias("records"), F.countDistinct("partition").alias("partitions"))
    return ts.topic_stats(log).join(counted, "topic")


@case(
    "latest_by_key_clock_skew",
    """SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS id FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
)
def latest_by_key_clock_skew(spark, sf_dir):
    """Offsets and clocks disagree: within a partition the offset decides."""
    placed = table_log(spark, sf_dir, ["shop.orders.1.placed"])
    o = F.from_json("value", "id BIGINT, customer_id BIGINT")
    rows = placed.select(
        "topic", F.lit(0).alias("partition"), o["id"].alias("offset"), "timestamp",
        o["customer_id"].cast("string").alias("key"), "value",
    )
    return ts.latest_by_key(rows).select("key", F.col("offset").alias("id"))


@case(
    "duplicate_keys_mixed",
    """SELECT 'shop.orders.1.placed' AS topic, count(*) AS duplicate_count FROM (SELECT k FROM
      (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'ORD-' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS k FROM orders)
      GROUP BY k HAVING count(*) > 1)""",
)
def duplicate_keys_mixed(spark, sf_dir):
    """Keys under a quoted name, some numbers and some texts: none is lost to the column's type."""
    o = F.from_json("value", "id BIGINT, customer_id BIGINT")
    customer = o["customer_id"].cast("string")
    name = F.when(o["id"] % 7 == 0, F.concat(F.lit("ORD-"), customer)).otherwise(customer)
    log = table_log(spark, sf_dir, ["shop.orders.1.placed"]).withColumn("value", F.to_json(F.struct(name.alias("buyer's"))))
    keys = spark.createDataFrame([("shop.orders.1.placed", "buyer's", "BIGINT")], "topic STRING, key_field STRING, key_type STRING")
    return ts.duplicate_keys(log, keys)


@case(
    "compare_by_customer",
    """SELECT c_custkey AS id, 'modified' AS status, c_custkey * 2 AS id_a, c_custkey * 2 + c_nationkey % 2 AS id_b
    FROM customer WHERE c_nationkey % 2 = 1""",
)
def compare_by_customer(spark, sf_dir):
    """Compared by one column while both sides have a column called ``id`` too."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    number = (F.col("c_custkey") * 2).cast("bigint")
    a = customer.select(F.col("c_custkey").alias("customer_id"), number.alias("id"), F.lit("x").alias("in_a"))
    b = customer.select(
        F.col("c_custkey").alias("customer_id"), (number + F.col("c_nationkey") % 2).alias("id"), F.lit("x").alias("in_a")
    )
    rows = ts.compare_topics(a, b, "customer_id", diff_only=True)
    return rows.select("id", "status", F.col("id_value.a").alias("id_a"), F.col("id_value.b").alias("id_b"))


@case(
    "typed_view_clash",
    """SELECT o_orderkey AS id, o_custkey AS "ID_1", 'e' || o_orderkey AS event_time_2, epoch_us(o_orderdate) // 1000 AS at
    FROM orders""",
)
def typed_view_clash(spark, sf_dir):
    """Fields that differ in case only, and one that is called like a column of the view."""
    o = F.from_json("value", "id BIGINT, customer_id BIGINT")
    text = F.format_string('{"id": %d, "ID": %d, "event_time": "e%d"}', o["id"], o["customer_id"], o["id"])
    log = table_log(spark, sf_dir, ["shop.orders.1.placed"]).withColumn("value", text)
    view = ts.topic_table(log, ts.schema_struct(ts.infer_schema(log), "shop.orders.1.placed"))
    return view.select("id", "ID_1", "event_time_2", F.unix_millis("event_time").alias("at"))


@case(
    "flow_catalog",
    log_cte("placed", "shipped")
    + """ SELECT 'shop.orders.' || s AS topic, (SELECT count(*) FROM log WHERE topic = 'shop.orders.' || s) AS message_count
    FROM (VALUES ('1.placed'), ('2.shipped'), ('3.closed'), ('4.paid')) t(s)""",
)
def flow_catalog(spark, sf_dir):
    """Steps that the broker lists and the log has no record of are steps with a count of 0."""
    log = table_log(spark, sf_dir, STEPS[:2])
    listed = [(STEPS[2], 0), ("shop.orders.4.paid", 0)]
    catalog = ts.topic_stats(log).unionByName(spark.createDataFrame(listed, "topic STRING, messages BIGINT"))
    return ts.flow_audit(log, catalog=catalog).select("topic", "message_count")


@case(
    "export_csv",
    """SELECT c_custkey, c_name, '{"segment":"' || c_mktsegment || '"}' AS nested FROM customer""",
)
def export_csv(spark, sf_dir):
    path = f"{checkpoint_root(spark)}/export-{uuid.uuid4().hex}"
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    ts.export(customer.select("c_custkey", "c_name", F.struct(F.col("c_mktsegment").alias("segment")).alias("nested")), path)
    return spark.read.schema("c_custkey BIGINT, c_name STRING, nested STRING").option("header", True).option("escape", "\\").csv(path)


# ---- tracing


def _edges(where: str, parts: tuple[str, ...], group: str = "") -> str:
    over = f"OVER ({'PARTITION BY ' + group if group else ''} ORDER BY ts_ms, topic, part, off)"
    return (
        log_cte(*parts)
        + f""", hits AS (SELECT * FROM log {where}),
    seq AS (SELECT *, lag(topic) {over} AS before, lag(ts_ms) {over} AS before_ms FROM hits)
    SELECT {group + ', ' if group else ''}before AS "from", topic AS "to", before_ms AS from_ms, ts_ms AS to_ms FROM seq
    WHERE before <> topic"""
    )


def _with_ms(edges, *group):
    return edges.select(*group, "from", "to", ms("from_ts", "from_ms"), ms("to_ts", "to_ms"))


SHOP_TOPICS = (*STEPS, "shop.orders.xml")
DOCS = ("raw.documents", "raw.pages", "chat.turns")
WORD_HITS = """, hits AS (SELECT * FROM log WHERE (topic = 'raw.documents' AND CAST(key AS BIGINT) IN
   (SELECT doc_id FROM documents WHERE contains(text, 'nde')))
   OR (topic = 'raw.pages' AND CAST(key AS BIGINT) IN (SELECT page_id FROM pages WHERE contains(html, 'nde')))
   OR (topic = 'chat.turns' AND (off % 1000, CAST(key AS BIGINT)) IN
     (SELECT (turn, conv_id) FROM conversations WHERE contains(text, 'nde') OR contains(role, 'nde'))))"""


@case(
    "trace_hits",
    log_cte("documents", "pages", "turns")
    + WORD_HITS
    + ' SELECT topic, part AS "partition", off AS "offset", ts_ms AS timestamp FROM hits',
)
def trace_hits(spark, sf_dir):
    hits = ts.trace_hits(table_log(spark, sf_dir), "nde", topics=DOCS)
    return hits.withColumn("timestamp", F.unix_millis("timestamp"))


@case(
    "trace_hits_indexed",
    """SELECT 'web.events.' || event_type AS topic, CAST(event_id % 4 AS INTEGER) AS "partition", event_id // 4 AS "offset",
      epoch_us(ts) // 1000 AS timestamp FROM events WHERE user_id = 77""",
)
def trace_hits_indexed(spark, sf_dir):
    """A search through the index of a stored log: half of it is indexed, the other half came later."""
    path = f"{checkpoint_root(spark)}/log-{uuid.uuid4().hex}"
    log = table_log(spark, sf_dir, list(WEB))
    half = F.max("offset").over(Window.partitionBy("topic", "partition")) / 2
    laid_out = log.repartition("topic", "partition").withColumn("_half", half).sortWithinPartitions("topic", "partition", "offset")
    laid_out.drop("_half").write.partitionBy("topic").parquet(f"{path}/log")
    laid_out.filter(F.col("offset") < F.col("_half")).drop("_half").write.parquet(f"{path}/first")
    ts.trace_index(spark.read.parquet(f"{path}/first"), block=256).write.parquet(f"{path}/index")
    stored = ts.read_topic(spark, f"{path}/log")
    hits = ts.trace_hits(stored, '"user_id":77,', index=spark.read.parquet(f"{path}/index"))
    return hits.withColumn("timestamp", F.unix_millis("timestamp"))


@case(
    "trace_nodes",
    log_cte("documents", "pages", "turns")
    + WORD_HITS
    + """ SELECT topic AS id, topic AS label, 'topic' AS type,
      CAST(row_number() OVER (ORDER BY min(ts_ms), topic) AS INTEGER) AS seq FROM hits GROUP BY topic""",
)
def trace_nodes(spark, sf_dir):
    return ts.trace_nodes(ts.trace_hits(table_log(spark, sf_dir), "nde", topics=DOCS))


@case("trace_edges", _edges("WHERE key = '77'", ("web", "dlt")).replace("before_ms AS", "'flow' AS label, before_ms AS"))
def trace_edges(spark, sf_dir):
    log = table_log(spark, sf_dir, [*WEB, "web.errors.dlt"])
    return _with_ms(ts.trace_edges(ts.trace_hits(log, "^77$", regex=True)), "label")


@case("trace_path", _edges("WHERE contains(key, '77')", ("web",)))
def trace_path(spark, sf_dir):
    log = table_log(spark, sf_dir, [*WEB, "web.errors.dlt"])
    return _with_ms(ts.trace_edges(ts.trace_hits(log, "77", path="$.user_id")))


@case("trace_xpath", _edges("WHERE topic = 'shop.orders.xml' AND CAST(key AS BIGINT) IN (SELECT o_orderkey FROM orders WHERE contains(CAST(o_custkey AS VARCHAR), '49')) OR topic = 'raw.documents' AND (contains(key, '49') OR CAST(key AS BIGINT) IN (SELECT doc_id FROM documents WHERE contains(text, '49')))", ("xml", "documents")))
def trace_xpath(spark, sf_dir):
    log = table_log(spark, sf_dir, ["shop.orders.xml", "raw.documents", "shop.orders.1.placed"])
    return _with_ms(ts.trace_edges(ts.trace_hits(log, "49", path="/Order/Customer")))


@case("trace_regex", _edges("WHERE topic LIKE 'web.events.%' AND CAST(key AS BIGINT) IN (71, 72)", ("web",)))
def trace_regex(spark, sf_dir):
    return _with_ms(ts.trace_edges(ts.trace_hits(table_log(spark, sf_dir, WEB), r'"user_id":7[12],', regex=True)))


@case(
    "trace_recent",
    _edges(
        """WHERE contains(key, '5') AND (topic, part, off) IN (SELECT (topic, part, off) FROM (SELECT topic, part, off FROM log
        QUALIFY row_number() OVER (PARTITION BY topic ORDER BY ts_ms DESC, part, off DESC) <= 5000))""",
        ("web",),
    ),
)
def trace_recent(spark, sf_dir):
    return _with_ms(ts.trace_edges(ts.trace_hits(table_log(spark, sf_dir, WEB), "5", path="$.user_id", n=5000)))


@case(
    "trace_since",
    _edges(
        "WHERE contains(key, '5') AND ts_ms >= epoch_us(TIMESTAMP '2024-01-31 00:00:00') // 1000 - 14400 * 60000",
        ("web",),
    ),
)
def trace_since(spark, sf_dir):
    end = datetime(2024, 1, 31, tzinfo=timezone.utc)
    hits = ts.trace_hits(table_log(spark, sf_dir, WEB), "5", path="$.user_id", minutes=14400, as_of=end)
    return _with_ms(ts.trace_edges(hits))


ALL_PARTS = ("web", "placed", "shipped", "closed")


@case("trace_all", _edges("", ALL_PARTS, "key"))
def trace_all(spark, sf_dir):
    return _with_ms(ts.trace_all(table_log(spark, sf_dir, [*WEB, *STEPS])), "key")


@case(
    "trace_all_counts",
    "WITH edges AS (" + _edges("", ALL_PARTS, "key") + ') SELECT "from", "to", count(*) AS n FROM edges GROUP BY ALL',
)
def trace_all_counts(spark, sf_dir):
    return ts.edge_counts(ts.trace_all(table_log(spark, sf_dir, [*WEB, *STEPS])))


# ---- comparison


def _moments(spark, sf_dir, topic):
    return _typed(spark, sf_dir, topic).select("id", F.unix_millis("event_time").alias("at"))


SIDES = """WITH a AS (SELECT l_orderkey AS id, epoch_us(min(l_shipdate)) // 1000 AS at FROM lineitem GROUP BY 1),
 b AS (SELECT l_orderkey AS id, epoch_us(max(l_shipdate)) // 1000 AS at FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
 compared AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b'
   WHEN a.at = b.at THEN 'equal' ELSE 'modified' END AS status, a.at AS at_a, b.at AS at_b,
   CAST(a.id IS NOT NULL AS BIGINT) AS messages_a, CAST(b.id IS NOT NULL AS BIGINT) AS messages_b,
   coalesce(a.at = b.at, false) AS same FROM a FULL JOIN b ON a.id = b.id)"""


def _flat(rows, column):
    return rows.select(
        "id", "status", "messages_a", "messages_b",
        F.col(f"{column}.a").alias(f"{column}_a"), F.col(f"{column}.b").alias(f"{column}_b"), F.col(f"{column}.same").alias("same"),
    )


@case("compare_topics", SIDES + " SELECT id, status, messages_a, messages_b, at_a, at_b, same FROM compared")
def compare_topics(spark, sf_dir):
    shipped, closed = _moments(spark, sf_dir, STEPS[1]), _moments(spark, sf_dir, STEPS[2])
    return _flat(ts.compare_topics(shipped, closed, "id"), "at")


@case(
    "compare_repeated_ids",
    """WITH t AS (SELECT user_id AS id, CAST(props ->> '$.k' AS INTEGER) // 10 AS k,
      CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS na, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS nb
      FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
    rest AS (SELECT id, k, na - least(na, nb) AS na, nb - least(na, nb) AS nb FROM t WHERE na <> nb),
    per_id AS (SELECT id, count(*) FILTER (na > 0) AS ca, count(*) FILTER (nb > 0) AS cb FROM rest GROUP BY id),
    tagged AS (SELECT rest.*, ca, cb, CASE WHEN cb = 0 THEN 'only_a' WHEN ca = 0 THEN 'only_b' ELSE 'modified' END AS status
      FROM rest JOIN per_id USING (id))
    SELECT id, 'equal' AS status, least(na, nb) AS messages_a, least(na, nb) AS messages_b, k AS k_a, k AS k_b, true AS same
      FROM t WHERE least(na, nb) > 0
    UNION ALL SELECT id, status, na, nb, CASE WHEN na > 0 THEN k END, CASE WHEN nb > 0 THEN k END, false FROM tagged
      WHERE ca > 1 OR cb > 1
    UNION ALL SELECT id, min(status), CAST(sum(na) AS BIGINT), CAST(sum(nb) AS BIGINT), max(k) FILTER (na > 0),
      max(k) FILTER (nb > 0), false FROM tagged WHERE ca <= 1 AND cb <= 1 GROUP BY id""",
)
def compare_repeated_ids(spark, sf_dir):
    k = F.get_json_object("value", "$.props.k").cast("int")
    click, view = (
        table_log(spark, sf_dir, [topic]).select(F.col("key").cast("bigint").alias("id"), F.expr("0").alias("k"), "value")
        .withColumn("k", F.floor(k / 10).cast("int")).drop("value")
        for topic in ("web.events.click", "web.events.view")
    )
    return _flat(ts.compare_topics(click, view, "id"), "k")


@case(
    "compare_diff_only",
    SIDES + " SELECT id, status, messages_a, messages_b, at_a, at_b, same FROM compared WHERE status <> 'equal'",
)
def compare_diff_only(spark, sf_dir):
    shipped, closed = _moments(spark, sf_dir, STEPS[1]), _moments(spark, sf_dir, STEPS[2])
    return _flat(ts.compare_topics(shipped, closed, "id", diff_only=True), "at")


@case(
    "compare_summary",
    SIDES
    + """ SELECT count(*) FILTER (status <> 'equal') AS differences, count(*) FILTER (status = 'modified') AS modified,
      count(*) FILTER (status = 'only_a') AS only_a, count(*) FILTER (status = 'only_b') AS only_b,
      count(at_a) AS messages_a, count(at_b) AS messages_b,
      round(count(at_a) * 1000.0 / (max(at_a) - min(at_a)), 9) AS msg_per_s_a,
      round(count(at_b) * 1000.0 / (max(at_b) - min(at_b)), 9) AS msg_per_s_b,
      CAST(1 AS BIGINT) AS schema_mismatches FROM compared""",
)
def compare_summary(spark, sf_dir):
    shipped, closed = (
        _typed(spark, sf_dir, topic).drop("raw_value", "proc_time").withColumn("at", F.unix_millis("event_time"))
        for topic in STEPS[1:]
    )
    summary = ts.compare_summary(shipped, closed, "id", ["at"], "event_time")
    return summary.withColumn("msg_per_s_a", F.round("msg_per_s_a", 9)).withColumn("msg_per_s_b", F.round("msg_per_s_b", 9))


@case(
    "missing_records",
    SIDES
    + """ SELECT id, CASE status WHEN 'only_a' THEN 'a' ELSE 'b' END AS side, messages_a + messages_b AS messages
    FROM compared WHERE status IN ('only_a', 'only_b')""",
)
def missing_records(spark, sf_dir):
    return ts.missing_records(_moments(spark, sf_dir, STEPS[1]), _moments(spark, sf_dir, STEPS[2]), "id")


@case(
    "schema_mismatch",
    log_cte("placed", "shipped")
    + COLUMNS
    + """ SELECT coalesce(a."column", b."column") AS "column", a.type AS type_a, b.type AS type_b
    FROM (SELECT * FROM inferred WHERE topic = 'shop.orders.1.placed') a
    FULL JOIN (SELECT * FROM inferred WHERE topic = 'shop.orders.2.shipped') b ON a."column" = b."column"
    WHERE a.type IS DISTINCT FROM b.type""",
)
def schema_mismatch(spark, sf_dir):
    inferred = ts.infer_schema(table_log(spark, sf_dir, STEPS[:2]))
    return ts.schema_mismatch(
        inferred.filter(F.col("topic") == STEPS[0]), inferred.filter(F.col("topic") == STEPS[1])
    )


@case(
    "throughput",
    log_cte()
    + """ SELECT topic, count(*) AS messages,
      CASE WHEN max(ts_ms) > min(ts_ms) THEN round(count(*) * 1000.0 / (max(ts_ms) - min(ts_ms)), 9) END AS msg_per_s
    FROM log GROUP BY topic""",
)
def throughput(spark, sf_dir):
    return ts.throughput(table_log(spark, sf_dir)).withColumn("msg_per_s", F.round("msg_per_s", 9))


# ---- metrics


def _events_table(spark, sf_dir):
    log = table_log(spark, sf_dir, WEB)
    return ts.topic_table(log, ts.schema_struct(ts.infer_schema(log.filter(F.col("topic") == WEB[0])), WEB[0]))


def _flat_labels(rows):
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("metric_value", F.array_join(pairs, ",").alias("labels"))


@case("metric_count", "SELECT CAST(count(*) AS DOUBLE) AS metric_value, '' AS labels FROM events")
def metric_count(spark, sf_dir):
    rows = ts.eval_metric(spark, "SELECT COUNT(*) AS Metric_Value FROM {events}", events=_events_table(spark, sf_dir))
    return _flat_labels(rows)


@case(
    "metric_grouped",
    """SELECT CAST(count(*) AS DOUBLE) AS metric_value, 'kind=' || event_type || ',source=web' AS labels
    FROM events GROUP BY event_type""",
)
def metric_grouped(spark, sf_dir):
    sql = "SELECT COUNT(*) AS metric_value, event_type AS Kind, 'web' AS source FROM {events} GROUP BY event_type"
    return _flat_labels(ts.eval_metric(spark, sql, events=_events_table(spark, sf_dir)))


@case(
    "metric_ratio",
    """SELECT round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 6) AS metric_value, '' AS labels
    FROM events""",
)
def metric_ratio(spark, sf_dir):
    sql = """SELECT CAST(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM {events}) AS DOUBLE) AS metric_value
    FROM {events} WHERE event_type = 'error'"""
    rows = _flat_labels(ts.eval_metric(spark, sql, events=_events_table(spark, sf_dir)))
    return rows.withColumn("metric_value", F.round("metric_value", 6))


@case(
    "metric_refresh",
    """SELECT 'events_' || event_type AS id, CAST(count(*) AS DOUBLE) AS metric_value, false AS failed
    FROM events GROUP BY event_type
    UNION ALL SELECT 'broken', NULL, true""",
)
def metric_refresh(spark, sf_dir):
    events = _events_table(spark, sf_dir)
    sql = "SELECT COUNT(*) AS metric_value, event_type AS kind FROM {{events}} WHERE event_type = '{}' GROUP BY event_type"
    kinds = [topic.rsplit(".", 1)[1] for topic in WEB]
    registry = spark.createDataFrame(
        [(f"events_{kind}", sql.format(kind)) for kind in kinds] + [("broken", "SELECT nothing FROM {events}")],
        "id STRING, sql STRING",
    )
    as_of = datetime(2024, 1, 31, tzinfo=timezone.utc)
    values = ts.refresh_metrics(spark, registry, {"events": events}, as_of)
    return values.select("id", "metric_value", F.col("error").isNotNull().alias("failed"))


SHARED = {
    "events": "SELECT COUNT(*) AS metric_value FROM {events}",
    "users_sum": "SELECT SUM(user_id) AS metric_value, 'click' AS kind FROM {events} WHERE event_type = 'click'",
    "by_kind": "SELECT event_type, COUNT(*) AS metric_value FROM {events} GROUP BY event_type",
    "mean_by_kind": "SELECT AVG(value) AS metric_value, event_type AS kind FROM {events} WHERE value > 50 GROUP BY event_type",
    "by_user": "SELECT MAX(event_id) AS metric_value, user_id FROM {events} WHERE user_id < 50 AND event_type <> 'view' GROUP BY user_id",
}


@case(
    "metric_shared_scan",
    """WITH told AS (
      SELECT 'events' AS id, CAST(count(*) AS DOUBLE) AS v, '' AS labels FROM events
      UNION ALL SELECT 'users_sum', CAST(sum(user_id) AS DOUBLE), 'kind=click' FROM events WHERE event_type = 'click'
      UNION ALL SELECT 'by_kind', CAST(count(*) AS DOUBLE), 'event_type=' || event_type FROM events GROUP BY event_type
      UNION ALL SELECT 'mean_by_kind', round(avg(value), 6), 'kind=' || event_type FROM events WHERE value > 50 GROUP BY event_type
      UNION ALL SELECT 'by_user', CAST(max(event_id) AS DOUBLE), 'user_id=' || user_id FROM events
        WHERE user_id < 50 AND event_type <> 'view' GROUP BY user_id)
    SELECT id, v AS metric_value, labels FROM told WHERE v IS NOT NULL""",
)
def metric_shared_scan(spark, sf_dir):
    """Five metrics with three groupings, from one scan of their table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    registry = spark.createDataFrame(list(SHARED.items()), "id STRING, sql STRING")
    values = ts.refresh_metrics(spark, registry, {"events": events}, datetime(2024, 1, 31, tzinfo=timezone.utc))
    pairs = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    value = F.when(F.col("id") == "mean_by_kind", F.round("metric_value", 6)).otherwise(F.col("metric_value"))
    return values.filter("error IS NULL").select("id", value.alias("metric_value"), F.array_join(pairs, ",").alias("labels"))


@case(
    "metric_status",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'red' WHEN c_custkey % 7 = 0 THEN 'unknown'
      WHEN c_acctbal >= 8000 THEN 'red' WHEN c_acctbal >= 5000 THEN 'amber' ELSE 'green' END AS status FROM customer""",
)
def metric_status(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("value"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit("failed")).alias("error"),
    )
    return rows.select("id", ts.metric_status("value", F.lit(5000.0), F.lit(8000.0), "error").alias("status"))


@case(
    "metric_history",
    """WITH last AS (SELECT user_id, ts, value FROM events QUALIFY row_number() OVER
      (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, value DESC) <= 50)
    SELECT 'user-' || user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, value) - 1
      AS INTEGER) AS place, value FROM last""",
)
def metric_history(spark, sf_dir):
    values = table_log(spark, sf_dir, WEB).select(
        F.concat(F.lit("user-"), "key").alias("id"),
        F.col("timestamp").alias("refreshed_at"),
        F.get_json_object("value", "$.value").cast("double").alias("metric_value"),
    )
    return ts.metric_history(values).select("id", F.posexplode("history").alias("place", "value"))


def _config_log(spark, sf_dir):
    metric_id = F.concat(F.lit("metric-"), F.col("o.customer_id").cast("string"))
    record = F.struct(
        metric_id.alias("id"),
        F.concat(F.lit("orders_"), F.col("o.status")).alias("name"),
        F.lit("GAUGE").alias("type"),
        (F.col("o.id") * 1.0).cast("double").alias("warningThreshold"),
        F.when(F.col("o.status") == "F", F.lit("DELETED")).alias("errorMessage"),
    )
    return _orders_as_log(spark, sf_dir, "internal.metrics.config", metric_id, record)


@case(
    "metric_registry",
    LAST_ORDER
    + """SELECT 'metric-' || o_custkey AS id, 'orders_' || o_orderstatus AS name,
      CAST(o_orderkey AS DOUBLE) AS "warningThreshold" FROM last WHERE o_orderstatus <> 'F'""",
)
def metric_registry(spark, sf_dir):
    return ts.metric_registry(_config_log(spark, sf_dir)).select("id", "name", "warningThreshold")


@case(
    "latest_by_key",
    LAST_ORDER + """SELECT 'metric-' || o_custkey AS key, epoch_us(o_orderdate) // 1000 AS timestamp FROM last""",
)
def latest_by_key(spark, sf_dir):
    return ts.latest_by_key(_config_log(spark, sf_dir)).select("key", ms("timestamp"))


@case(
    "metric_state",
    LAST_ORDER
    + """, firsts AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS v, max(o_orderkey) AS n FROM orders
      WHERE o_custkey % 5 <> 0 GROUP BY o_custkey)
    SELECT 'metric-' || l.o_custkey AS id, f.v AS "lastValue",
      CASE WHEN l.o_custkey % 5 = 0 THEN 'failed' END AS "errorMessage"
    FROM last l LEFT JOIN firsts f USING (o_custkey) WHERE l.o_orderstatus <> 'F'""",
)
def metric_state(spark, sf_dir):
    log = _config_log(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    failed = F.col("o_custkey") % 5 == 0
    values = orders.select(
        F.concat(F.lit("metric-"), F.col("o_custkey").cast("string")).alias("id"),
        F.col("o_orderkey").alias("seq"),
        F.when(~failed, F.col("o_totalprice")).alias("metric_value"),
        F.when(failed, F.lit("failed")).alias("error"),
        F.timestamp_millis(F.lit(1704067200000)).alias("refreshed_at"),
    )
    return ts.metric_state(ts.metric_registry(log), values).select("id", "lastValue", "errorMessage")


# ---- lineage


def _statements(spark, sf_dir):
    """Statements made from the tables: a table per topic, a view per customer, a running INSERT per supplier."""
    topics = table_log(spark, sf_dir, [*WEB, *STEPS]).select("topic").distinct()
    name = F.regexp_replace("topic", r"\.", "_")
    tables = topics.select(
        name.alias("id"),
        F.lit("table").alias("kind"),
        F.concat(F.lit("CREATE TABLE "), name, F.lit(" (id BIGINT) WITH ('topic' = '"), "topic", F.lit("')")).alias("ddl"),
    )
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("c"), F.col("c_nationkey").cast("string").alias("n")
    )
    views = customer.select(
        F.concat(F.lit("view_"), "c").alias("id"),
        F.lit("view").alias("kind"),
        F.concat(
            F.lit("CREATE VIEW view_"), "c", F.lit(" AS SELECT * FROM shop_orders_1_placed o join nation_"), "n",
            F.lit(" n ON o.id = n.id"),
        ).alias("ddl"),
    )
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("s"), F.col("s_nationkey").cast("string").alias("n")
    )
    jobs = supplier.select(
        F.concat("s", F.lit("-job")).alias("id"),
        F.lit("job").alias("kind"),
        F.concat(
            F.lit("INSERT INTO sink_"), "n", F.lit(" SELECT * FROM web_events_click, t JOIN view_"), F.ltrim(F.col("s")),
            F.lit(" v ON true"),
        ).alias("ddl"),
    )
    return tables.unionByName(views).unionByName(jobs)


LINEAGE = """WITH topics AS (SELECT DISTINCT 'web.events.' || event_type AS topic FROM events
   UNION ALL VALUES ('shop.orders.1.placed'), ('shop.orders.2.shipped'), ('shop.orders.3.closed')),
 jobs AS (SELECT 'query_' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '-job' AS node, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS s,
   s_nationkey AS n FROM supplier)"""
LINEAGE_EDGES = (
    LINEAGE
    + """, edges AS (SELECT 'topic_' || topic AS "from", replace(topic, '.', '_') AS "to", 'source' AS label FROM topics
  UNION ALL SELECT 'shop_orders_1_placed', 'view_' || c_custkey, 'depends' FROM customer
  UNION ALL SELECT 'nation_' || c_nationkey, 'view_' || c_custkey, 'depends' FROM customer
  UNION ALL SELECT 'web_events_click', node, 'reads' FROM jobs
  UNION ALL SELECT 't', node, 'reads' FROM jobs
  UNION ALL SELECT 'view_' || s, node, 'reads' FROM jobs
  UNION ALL SELECT node, 'sink_' || n, 'writes' FROM jobs)"""
)


@case("lineage_edges", LINEAGE_EDGES + ' SELECT "from", "to", label FROM edges')
def lineage_edges(spark, sf_dir):
    return ts.lineage_edges(_statements(spark, sf_dir))


@case(
    "lineage_known_edges",
    LINEAGE_EDGES
    + """ SELECT "from", "to", label FROM edges WHERE label IN ('source', 'writes')
      OR "from" IN ('shop_orders_1_placed', 'web_events_click')""",
)
def lineage_known_edges(spark, sf_dir):
    return ts.lineage_edges(_statements(spark, sf_dir), known_only=True)


@case(
    "lineage_nodes",
    LINEAGE
    + """ SELECT node AS id, 'INSERT' AS label, 'query' AS type FROM jobs
    UNION ALL SELECT replace(topic, '.', '_'), replace(topic, '.', '_'), 'table' FROM topics
    UNION ALL SELECT 'topic_' || topic, topic, 'topic' FROM topics
    UNION ALL SELECT 'view_' || c_custkey, 'view_' || c_custkey, 'view' FROM customer""",
)
def lineage_nodes(spark, sf_dir):
    return ts.lineage_nodes(_statements(spark, sf_dir))
