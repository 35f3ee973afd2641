"""Event-time windows in batch, and streaming queries over the same tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

import topicspark as ts
from suite.registry import WEB, case, ms
from topicspark.operators.shared import checkpoint_root
from topicspark.sources.tables import table_log

HOUR = "epoch_us(ts) // 3600000000 * 3600000"
TUMBLE = f"""SELECT 'web.events.' || event_type AS topic, {HOUR} AS window_start, {HOUR} + 3600000 AS window_end,
  count(*) AS messages FROM events GROUP BY 1, 2, 3"""
HOP = """SELECT start AS window_start, start + 3600000 AS window_end, count(*) AS messages FROM
  (SELECT unnest([epoch_us(ts) // 1800000000 * 1800000, epoch_us(ts) // 1800000000 * 1800000 - 1800000]) AS start FROM events)
  GROUP BY start"""
SESSION = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS t FROM events),
  marked AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 7200000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY key ORDER BY t)),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM marked)
  SELECT key, min(t) AS window_start, max(t) + 7200000 AS window_end, count(*) AS messages FROM numbered GROUP BY key, s"""


def _log(spark, sf_dir, streaming=False, topics=WEB):
    return table_log(spark, sf_dir, topics, streaming).withColumnRenamed("timestamp", "event_time")


def _with_ms(windows):
    rest = [name for name in windows.columns if name not in ("window_start", "window_end")]
    return windows.select(ms("window_start"), ms("window_end"), *rest)


@case("tumble", TUMBLE)
def tumble(spark, sf_dir):
    return _with_ms(ts.tumble(_log(spark, sf_dir), "1 hour", by=["topic"]))


@case("hop", HOP)
def hop(spark, sf_dir):
    return _with_ms(ts.hop(_log(spark, sf_dir), "1 hour", "30 minutes"))


@case("session", SESSION)
def session(spark, sf_dir):
    return _with_ms(ts.session(_log(spark, sf_dir), "2 hours", by=["key"]))


@case(
    "tumble_aggregates",
    """SELECT epoch_us(ts) // 86400000000 * 86400000 AS window_start, epoch_us(ts) // 86400000000 * 86400000 + 86400000 AS window_end,
      count(*) AS messages, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean
    FROM events GROUP BY 1, 2""",
)
def tumble_aggregates(spark, sf_dir):
    value = F.get_json_object("value", "$.value").cast("double")
    aggs = [
        F.count("*").alias("messages"), F.round(F.sum("amount"), 4).alias("total"), F.min("amount").alias("low"),
        F.max("amount").alias("high"), F.round(F.avg("amount"), 6).alias("mean"),
    ]
    return _with_ms(ts.tumble(_log(spark, sf_dir).withColumn("amount", value), "1 day", aggs=aggs))


@case("tumble_stream", TUMBLE)
def tumble_stream(spark, sf_dir):
    return _with_ms(ts.run_available_now(ts.tumble(_log(spark, sf_dir, True), "1 hour", by=["topic"])))


@case("hop_stream", HOP)
def hop_stream(spark, sf_dir):
    return _with_ms(ts.run_available_now(ts.hop(_log(spark, sf_dir, True), "1 hour", "30 minutes")))


@case(
    "session_all",
    """WITH e AS (SELECT epoch_us(ts) // 1000 AS t FROM events),
    marked AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 60000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (ORDER BY t)),
    numbered AS (SELECT *, sum(fresh) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM marked)
    SELECT min(t) AS window_start, max(t) + 60000 AS window_end, count(*) AS messages FROM numbered GROUP BY s""",
)
def session_all(spark, sf_dir):
    """Sessions of the whole log, without a key."""
    return _with_ms(ts.session(_log(spark, sf_dir), "1 minute"))


@case("session_stream", SESSION)
def session_stream(spark, sf_dir):
    return _with_ms(ts.run_available_now(ts.session(_log(spark, sf_dir, True), "2 hours", by=["key"])))


@case("running_counts_stream", "SELECT 'web.events.' || event_type AS topic, count(*) AS message_count FROM events GROUP BY 1")
def running_counts_stream(spark, sf_dir):
    return ts.run_available_now(ts.exact_counts(_log(spark, sf_dir, True)))


@case(
    "duplicates_stream",
    """SELECT 'web.events.' || event_type AS topic, CAST(user_id AS VARCHAR) AS key, count(*) AS messages
    FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicates_stream(spark, sf_dir):
    return ts.run_available_now(ts.duplicates_stream(_log(spark, sf_dir, True), ["topic", "key"]))


@case(
    "duplicates_window_stream",
    """WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, user_id, count(*) AS n FROM events
      GROUP BY ALL HAVING count(*) > 1)
    SELECT epoch_us(start) // 1000 AS window_start, 'web.events.' || event_type AS topic, CAST(user_id AS VARCHAR) AS key,
      n AS messages FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 5 SECOND""",
)
def duplicates_window_stream(spark, sf_dir):
    """Repeats within a day, from closed days: state is kept for the open ones only."""
    repeats = ts.duplicates_stream(_log(spark, sf_dir, True), ["topic", "key"], within="1 day", lateness="5 seconds")
    return ts.run_available_now(repeats, "append").select(ms("window_start"), "topic", "key", "messages")


def _small_batches(spark, sf_dir):
    """The log as a stream that takes one file at a time."""
    folder = f"{checkpoint_root(spark)}/batches-{uuid.uuid4().hex}"
    table_log(spark, sf_dir, list(WEB)).repartition(3, "offset").write.partitionBy("topic").parquet(folder)
    return ts.read_topic(spark, folder, streaming=True, options={"maxFilesPerTrigger": "1"})


@case(
    "update_stream",
    "SELECT 'web.events.' || event_type AS topic, count(*) AS message_count FROM events GROUP BY 1",
)
def update_stream(spark, sf_dir):
    """Counts in update mode over several micro-batches: the last version of each row."""
    return ts.run_available_now(ts.exact_counts(_small_batches(spark, sf_dir)), "update", keys=["topic"])


@case(
    "closed_windows_stream",
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1)
    SELECT epoch_us(start) // 1000 AS window_start, n FROM w
    WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 5 SECOND""",
)
def closed_windows_stream(spark, sf_dir):
    """Append mode: a window comes out once, when the watermark has passed its end."""
    log = _log(spark, sf_dir, True).withWatermark("event_time", "5 seconds")
    counts = log.groupBy(F.window("event_time", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return ts.run_available_now(counts, "append").select(ms("w.start", "window_start"), "n")


@case(
    "insert_restart_stream",
    "SELECT 'web.events.' || event_type AS topic, CAST(event_id // 4 AS BIGINT) AS off, CAST(event_id % 4 AS INTEGER) AS part FROM events",
)
def insert_restart_stream(spark, sf_dir):
    """A long-running INSERT that is stopped and started again on its checkpoint: what came meanwhile is not lost."""
    base = f"{checkpoint_root(spark)}/insert-{uuid.uuid4().hex}"
    log = table_log(spark, sf_dir, list(WEB))
    for remainder in (0, 1):
        part = log.filter(F.col("offset") % 2 == remainder)
        part.write.mode("append").partitionBy("topic").parquet(f"{base}/log")
        stream = ts.read_topic(spark, f"{base}/log", mode="latest", streaming=True, since=datetime(1970, 1, 2, tzinfo=timezone.utc))
        ts.start_insert(stream, f"{base}/out", f"{base}/state", once=True).awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.select("topic", F.col("offset").alias("off"), F.col("partition").alias("part"))


@case(
    "bounded_read_stream",
    "SELECT 'web.events.' || event_type AS topic, CAST(event_id // 4 AS BIGINT) AS off, CAST(event_id % 4 AS INTEGER) AS part FROM events",
)
def bounded_read_stream(spark, sf_dir):
    """The first rows of a running query, in whole micro-batches: the files that are there make up the first."""
    stream = _log(spark, sf_dir, True).select("topic", F.col("offset").alias("off"), F.col("partition").alias("part"))
    return ts.read_bounded(stream, rows=1)


@case(
    "metric_refresh_stream",
    """SELECT event_type AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, min(user_id) AS first_user, max(user_id) AS last_user,
      round(avg(user_id), 6) AS mean_user FROM events GROUP BY event_type""",
)
def metric_refresh_stream(spark, sf_dir):
    """A metric kept up to date over three starts of a stream: each merges the files that came since the last."""
    base = f"{checkpoint_root(spark)}/metric-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("event_type").alias("kind"))
    view = ts.MetricView(["kind"], {
        "n": ("count", None), "total": ("sum", "event_id"), "first_user": ("min", "user_id"), "last_user": ("max", "user_id"),
        "mean_user": ("avg", "user_id"),
    })
    for batch in range(3):
        events.filter(F.col("event_id") % 3 == batch).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        ts.start_metric(stream, view, f"{base}/state", f"{base}/checkpoint", once=True).awaitTermination()
    rows = view.read(spark, f"{base}/state")
    return rows.withColumn("mean_user", F.round("mean_user", 6))


@case(
    "join_reference_stream",
    """SELECT o_orderkey AS id, c_custkey AS customer_id,
      CASE WHEN c_custkey % 2 = 0 AND o_orderdate >= TIMESTAMP '1995-06-01' THEN 'moved ' || c_mktsegment ELSE c_mktsegment END AS segment
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_reference_stream(spark, sf_dir):
    """Orders as a stream, joined with the customers as they were: half of them change between two starts, and the
    second start reads orders from before and after that change."""
    base = f"{checkpoint_root(spark)}/reference-{uuid.uuid4().hex}"
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    segment = F.col("c_mktsegment")
    for since, moved, chosen in (("1970-01-01", segment, F.lit(True)), ("1995-06-01", F.concat(F.lit("moved "), segment), F.col("c_custkey") % 2 == 0)):
        changes = customers.filter(chosen).select(
            F.col("c_custkey").alias("customer_id"), F.lit(since).cast("timestamp").alias("since"), moved.alias("segment")
        )
        changes.write.mode("append").parquet(f"{base}/changes")
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp").alias("at")
        )
        early = (F.col("at") < F.lit("1995-01-01").cast("timestamp")) & (F.col("id") % 2 == 0)
        orders.filter(early if since == "1970-01-01" else ~early).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(orders.schema).parquet(f"{base}/in")
        ts.start_reference_join(
            stream, lambda session: session.read.parquet(f"{base}/changes"), "customer_id", "at", "since",
            f"{base}/out", f"{base}/checkpoint", once=True,
        ).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "customer_id", F.col("reference.segment").alias("segment"))


@case(
    "tumble_text",
    """SELECT 'web.events.' || event_type AS kind, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS window_start,
      epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 + 3600000 AS window_end, count(*) AS metric_value
    FROM events GROUP BY ALL""",
)
def tumble_text(spark, sf_dir):
    """A metric in the text that streaming SQL has for windows."""
    sql = """SELECT topic AS kind, window_start, window_end, COUNT(*) AS metric_value
      FROM TABLE(TUMBLE(TABLE {events}, DESCRIPTOR(event_time), INTERVAL '1' HOUR))
      GROUP BY topic, window_start, window_end"""
    rows = ts.run_sql(spark, sql, events=_log(spark, sf_dir, False))
    return rows.select("kind", ms("window_start"), ms("window_end"), "metric_value")


@case(
    "hop_text",
    """SELECT epoch_us(start) // 1000 AS window_start, count(*) AS metric_value
    FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events)
    GROUP BY ALL""",
)
def hop_text(spark, sf_dir):
    sql = """SELECT window_start, COUNT(*) AS metric_value
      FROM TABLE(HOP(TABLE {events}, DESCRIPTOR(event_time), INTERVAL '30' MINUTES, INTERVAL '1' HOUR)) GROUP BY window_start"""
    return ts.run_sql(spark, sql, events=_log(spark, sf_dir, False)).select(ms("window_start"), "metric_value")


@case(
    "latest_restart",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey % 3 AS batch FROM customer WHERE c_custkey % 3 > 0""",
)
def latest_restart(spark, sf_dir):
    """A stream from the end of a log, stopped and started again without being told a time: it gives what came after
    its first start, also what came while it was down."""
    base = f"{checkpoint_root(spark)}/latest-{uuid.uuid4().hex}"
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 3).alias("batch"))
    for batch in range(3):
        ts.write_log(customers.filter(F.col("batch") == batch), "c_custkey", "copy.customers", f"{base}/log", batch=f"b-{batch}")
        stream = ts.read_topic(spark, f"{base}/log", mode="latest", streaming=True)
        ts.start_insert(stream, f"{base}/out", f"{base}/state", once=True).awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.select("key", F.get_json_object("value", "$.batch").cast("long").alias("batch"))


LATENCY = """SELECT CAST(a.user_id AS VARCHAR) AS key, epoch_us(a.ts) // 1000 AS ts_a, epoch_us(b.ts) // 1000 AS ts_b,
  epoch_us(b.ts) // 1000 - epoch_us(a.ts) // 1000 AS latency_ms
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
  AND epoch_us(b.ts) // 1000 > epoch_us(a.ts) // 1000 AND epoch_us(b.ts) // 1000 <= epoch_us(a.ts) // 1000 + 14400000"""


def _latency(spark, sf_dir, streaming):
    clicks = _log(spark, sf_dir, streaming, ["web.events.click"])
    purchases = _log(spark, sf_dir, streaming, ["web.events.purchase"])
    return ts.step_latency_stream(clicks, purchases, "key", "4 hours")


@case("latency_interval", LATENCY)
def latency_interval(spark, sf_dir):
    return _latency(spark, sf_dir, False).select("key", ms("ts_a"), ms("ts_b"), "latency_ms")


@case("latency_stream", LATENCY)
def latency_stream(spark, sf_dir):
    rows = ts.run_available_now(_latency(spark, sf_dir, True), "append")
    return rows.select("key", ms("ts_a"), ms("ts_b"), "latency_ms")
