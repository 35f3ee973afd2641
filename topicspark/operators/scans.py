"""Scans of a topic log, the topic catalog, and filters over it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.model import PREVIEW_SAMPLE
from topicspark.operators.shared import first_per_topic


def _hour() -> Column:
    return F.expr("unix_millis(timestamp) div 3600000")


def tail_records(log: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` records of each topic, by (timestamp, partition, offset)."""
    order = [F.desc("timestamp"), F.asc("partition"), F.desc("offset")]
    return first_per_topic(log, order, n, _hour(), newest=True)


def records_since(log: DataFrame, minutes: int, n: int | None, as_of: datetime) -> DataFrame:
    """Records of the last ``minutes`` before ``as_of``, at most ``n`` per topic, oldest first."""
    start = F.lit(as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    recent = log.filter(F.col("timestamp") >= start)
    if n is None:
        return recent
    return first_per_topic(recent, [F.asc("timestamp"), F.asc("partition"), F.asc("offset")], n, _hour())


def head_sample(log: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` records with a value of each topic's partition 0."""
    rows = log.filter("partition = 0 AND value IS NOT NULL")
    return first_per_topic(rows, [F.asc("offset")], n, F.expr("offset div 65536"))


def sample_messages(log: DataFrame, n: int = PREVIEW_SAMPLE) -> DataFrame:
    """Newest ``n`` records of each topic, without those that have no value (dropped after the limit)."""
    return tail_records(log, n).filter("value IS NOT NULL")


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` rows of a table, in log order where it has one."""
    order = [name for name in ("partition", "offset") if name in df.columns]
    return (df.orderBy(*order) if order else df).limit(n)


def _partition_ends(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "partition").agg(
        F.min("offset").alias("begin"), (F.max("offset") + 1).alias("end")
    )


def topic_stats(log: DataFrame, topics: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Messages per topic by offsets, Σ(end − begin); topics named but not in the log count 0."""
    sizes = _partition_ends(log).groupBy("topic").agg(F.sum(F.expr("end - begin")).alias("messages"))
    if topics is None:
        return sizes
    if not isinstance(topics, DataFrame):
        topics = log.sparkSession.createDataFrame([(name,) for name in topics], "topic STRING")
    return topics.select("topic").join(sizes, "topic", "left").select("topic", F.coalesce("messages", F.lit(0)).alias("messages"))


def topic_descriptor(log: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Partition count, begin and end offset of each partition, format, and size by offsets.

    ``formats`` (topic, format) fills the format column; without it the format is ``AUTO``.
    """
    described = (
        _partition_ends(log)
        .groupBy("topic")
        .agg(
            F.count("*").cast("int").alias("partitions"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("partition", "begin")))).alias("min_offsets"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("partition", "end")))).alias("max_offsets"),
            F.sum(F.expr("end - begin")).alias("estimated_size"),
        )
    )
    if formats is None:
        described = described.withColumn("format", F.lit("AUTO"))
    else:
        described = described.join(formats, "topic", "left").fillna("AUTO", ["format"])
    return described.select("topic", "partitions", "min_offsets", "max_offsets", "format", "estimated_size")


def tail_offsets(log: DataFrame, n: int) -> DataFrame:
    """One row of JSON: where a broker scan of each partition's last ``n`` offsets starts (``startingOffsets``)."""
    starts = _partition_ends(log).select(
        "topic", F.col("partition").cast("string").alias("partition"), F.expr(f"greatest(0, end - {int(n)})").alias("at")
    )
    by_partition = F.map_from_entries(F.sort_array(F.collect_list(F.struct("partition", "at"))))
    # Topic names hold letters, digits and "._-" only, so they need no escaping.
    named = F.concat(F.lit('"'), "topic", F.lit('":'), F.to_json(by_partition))
    per_topic = starts.groupBy("topic").agg(named.alias("named"))
    texts = F.array_join(F.sort_array(F.collect_list("named")), ",")
    return per_topic.agg(F.concat(F.lit("{"), texts, F.lit("}")).alias("starting_offsets"))


def topic_state(messages: Column | str = "messages", topic: Column | str = "topic") -> Column:
    """``Empty``, ``DLT`` or ``Healthy``, tested in this order."""
    size = F.col(messages) if isinstance(messages, str) else messages
    name = F.col(topic) if isinstance(topic, str) else topic
    return (
        F.when(size == 0, F.lit("Empty")).when(F.lower(name).endswith(".dlt"), F.lit("DLT")).otherwise(F.lit("Healthy"))
    )


def filter_topics(
    stats: DataFrame,
    prefix: str | None = None,
    name: str | None = None,
    contains: str | None = None,
    hide_dlt: bool = False,
    non_empty: bool = False,
) -> DataFrame:
    """Topics of a catalog by name and size, each with its state."""
    kept = stats
    if prefix is not None:
        kept = kept.filter(F.col("topic").startswith(prefix))
    if name is not None:
        kept = kept.filter(F.col("topic") == name)
    if contains is not None:
        kept = kept.filter(F.lower("topic").contains(contains.lower()))
    if hide_dlt:
        kept = kept.filter(~F.lower("topic").endswith(".dlt"))
    if non_empty:
        kept = kept.filter("messages > 0")
    return kept.select("topic", "messages", topic_state().alias("state"))
