"""Answers put together from several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.model import PREVIEW_SAMPLE
from topicspark.operators.profile import merged_columns, scan_values, topic_facts
from topicspark.operators.scans import sample_messages, topic_descriptor, topic_state, topic_stats
from topicspark.operators.schema import detect_format, infer_schema
from topicspark.operators.shared import checkpointed


def topic_detail(log: DataFrame, samples: int = PREVIEW_SAMPLE, n: int | None = None) -> DataFrame:
    """One row per topic: descriptor, format, inferred columns in order, and the newest messages."""
    if n is None:
        partial = scan_values(log, keys=False)
        formats = checkpointed(topic_facts(partial).select("topic", "format"))
        columns = merged_columns(partial, formats)
    else:
        formats = detect_format(log, n)
        columns = infer_schema(log, n, formats)
    columns = columns.groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "column", "type"))).alias("columns")
    )
    newest = sample_messages(log, samples).groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("timestamp", "partition", "offset", "value")), asc=False).alias("samples")
    )
    return topic_descriptor(log, formats).join(columns, "topic", "left").join(newest, "topic", "left")


def dashboard(log: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row: topics, messages, and topics in each state."""
    sizes = topic_stats(log) if stats is None else stats
    state = topic_state()
    return sizes.agg(
        F.count("*").alias("topics"),
        F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"),
        F.count_if(state == "Healthy").alias("healthy"),
        F.count_if(state == "Empty").alias("empty"),
        F.count_if(state == "DLT").alias("dead_letter"),
    )
