"""Scans and sinks of topic logs (Kafka, or Parquet partitioned by topic)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicspark.model import LOG_COLUMNS, LOG_SCHEMA
from topicspark.operators.shared import checkpointed
from topicspark.sources.committed import commits, data_folder, read_committed, stream_committed, write_commit


def kafka_options(
    bootstrap_servers: str,
    mode: str = "PLAIN",
    *,
    truststore_path: str | None = None,
    truststore_password: str | None = None,
    keystore_path: str | None = None,
    keystore_password: str | None = None,
    key_password: str | None = None,
    api_key: str | None = None,
    api_secret: str | None = None,
) -> dict[str, str]:
    """Client options, with Spark's ``kafka.`` prefix, shared by every scan and sink.

    ``mode`` is ``PLAIN``, ``SSL`` or ``CONFLUENT_CLOUD`` (SASL over TLS with an API key), in any case.
    """
    client = {"bootstrap.servers": bootstrap_servers}
    mode = mode.upper()
    if mode == "SSL":
        client["security.protocol"] = "SSL"
        stores = {
            "ssl.truststore.location": truststore_path,
            "ssl.truststore.password": truststore_password,
            "ssl.keystore.location": keystore_path,
            "ssl.keystore.password": keystore_password,
            "ssl.key.password": key_password,
        }
        client.update({name: text for name, text in stores.items() if text is not None})
    elif mode not in ("PLAIN", "CONFLUENT_CLOUD"):
        raise ValueError(f"unknown security mode {mode!r}; use 'PLAIN', 'SSL' or 'CONFLUENT_CLOUD'")
    if mode == "CONFLUENT_CLOUD":
        client["security.protocol"] = "SASL_SSL"
        client["sasl.mechanism"] = "PLAIN"
        client["sasl.jaas.config"] = (
            "org.apache.kafka.common.security.plain.PlainLoginModule required "
            f'username="{api_key}" password="{api_secret}";'
        )
    return {f"kafka.{name}": text for name, text in client.items()}


def read_topic(
    spark: SparkSession,
    source: str,
    topics: Sequence[str] | None = None,
    mode: str = "earliest",
    options: Mapping[str, str] | None = None,
    streaming: bool = False,
    since: datetime | None = None,
    starting_offsets: str | None = None,
) -> DataFrame:
    """Topic log of ``topics`` (all when None), as a batch or streaming frame.

    ``source`` is ``"kafka"`` or the path of a Parquet log partitioned by topic.  ``mode="latest"`` reads new
    records only: a stream from Kafka, or over a log with commits (one that ``write_log`` writes), starts at the end
    and goes on from its checkpoint; anything else starts at ``since``, which a restarted stream has to be given again.
    Any other mode reads from the start, or on Kafka from ``starting_offsets`` (JSON, as ``tail_offsets`` gives it).
    On Parquet the topic list prunes directories and ``since`` reaches the row groups' statistics.  Of a log with
    commits, finished writes alone are read.
    """
    latest = mode == "latest"
    committed = source != "kafka" and streaming and since is None and commits(spark, source) is not None
    if committed:
        return stream_committed(spark, source, topics, latest)
    if latest and since is None and not (streaming and source == "kafka"):
        # The clock at a restart would pass over what came while the query was down.
        raise ValueError("mode='latest' needs `since`, the time its records start at")
    reader = (spark.readStream if streaming else spark.read).options(**(options or {}))
    if source == "kafka":
        reader = reader.format("kafka")
        if topics:
            reader = reader.option("subscribe", ",".join(topics))
        else:
            # All topics but the broker's own two.
            reader = reader.option("subscribePattern", "(?!__consumer_offsets$|__transaction_state$).*")
        if since is not None:
            reader = reader.option("startingTimestamp", str(int(since.timestamp() * 1000)))
            reader = reader.option("startingOffsetsByTimestampStrategy", "latest")
        else:
            reader = reader.option("startingOffsets", starting_offsets or ("latest" if latest else "earliest"))
        records = reader.load().select(
            "topic",
            "partition",
            "offset",
            "timestamp",
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
        )
        return records if since is None else records.filter(F.col("timestamp") >= F.lit(since))
    log = None if streaming else read_committed(spark, source, dict(options or {}), topics)
    if log is None:
        log = reader.schema(LOG_SCHEMA).parquet(source).select(*LOG_COLUMNS)
    if topics:
        log = log.filter(F.col("topic").isin(list(topics)))
    if since is not None:
        log = log.filter(F.col("timestamp") >= F.lit(since))
    return log


def write_log(
    df: DataFrame,
    key: str | Column,
    topic: str,
    sink: str,
    options: Mapping[str, str] | None = None,
    timestamp: Column | None = None,
    partitions: int = 4,
    batch: str | None = None,
) -> None:
    """Append one keyed JSON record per row of ``df`` to ``topic``.

    ``sink`` is ``"kafka"`` or the path of a Parquet log.  A tombstone is a row whose own columns say so.
    On Parquet a record's partition follows from its key, and each partition's offsets go on without gaps from its
    last one: the tasks' counts are summed first, and each task numbers its own records.  The last offsets come from
    the log's commits, not from its records.  ``batch`` names the write: one that is finished already is not done
    again, and what a failed one left is replaced.  A topic has one writer at a time.
    """
    key_column = F.col(key) if isinstance(key, str) else key
    if sink == "kafka":
        records = df.select(key_column.cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
        records.write.format("kafka").options(**(options or {})).option("topic", topic).save()
        return
    spark = df.sparkSession
    batch = batch or uuid.uuid4().hex
    done = commits(spark, sink, topic)
    if done is not None and done.filter(F.col("batch") == batch).limit(1).count():
        return
    at = (F.current_timestamp() if timestamp is None else timestamp).alias("timestamp")
    place = F.coalesce(F.pmod(F.xxhash64("key"), F.lit(partitions)), F.lit(0)).cast("int").alias("partition")
    records = df.select(key_column.cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), at)
    placed = checkpointed(
        records.select("*", place, F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_row"))
    )
    counts = placed.groupBy("partition", "_task").agg(F.count("*").alias("_n"))
    tasks = Window.partitionBy("partition").orderBy("_task")
    counts = counts.withColumn("_before", F.sum("_n").over(tasks) - F.col("_n"))
    begun = _next_offsets(spark, sink, topic, done)
    counts = counts.join(begun, "partition", "left") if begun is not None else counts.withColumn("_next", F.lit(0))
    counts = checkpointed(counts.withColumn("_next", F.coalesce("_next", F.lit(0)).cast("long")))
    own = F.row_number().over(Window.partitionBy("partition", "_task").orderBy("_row")) - 1
    offset = (F.col("_next") + F.col("_before") + F.col("_own")).cast("long").alias("offset")
    numbered = placed.withColumn("_own", own).join(counts.drop("_n"), ["partition", "_task"])
    numbered = numbered.select("partition", offset, "timestamp", "key", "value")
    numbered.write.mode("overwrite").parquet(data_folder(sink, topic, batch))
    added = counts.groupBy("partition").agg(F.max("_next").alias("first_offset"), F.sum("_n").alias("records"))
    write_commit(added.withColumn("next_offset", F.col("first_offset") + F.col("records")), sink, topic, batch)


def _next_offsets(spark: SparkSession, path: str, topic: str, done: DataFrame | None) -> DataFrame | None:
    """(partition, _next) of a topic: from its commits, and from what other writers put in its folder."""
    ends = [] if done is None else [done.select("partition", F.col("next_offset").alias("_next"))]
    try:
        log = spark.read.schema(LOG_SCHEMA).parquet(f"{path.rstrip('/')}/topic={topic}/*.parquet")
        ends.append(log.select("partition", (F.col("offset") + 1).alias("_next")))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    if not ends:
        return None
    return reduce(DataFrame.unionByName, ends).groupBy("partition").agg(F.max("_next").alias("_next"))


def export(df: DataFrame, path: str, format: str = "csv") -> None:
    """Save a result as CSV (with a header; nested columns as JSON text) or as JSON lines."""
    if format == "json":
        df.write.mode("overwrite").json(path)
    elif format == "csv":
        nested = ("struct", "array", "map")
        flat = [
            F.to_json(name).alias(name) if kind.startswith(nested) else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown export format {format!r}; use 'csv' or 'json'")
