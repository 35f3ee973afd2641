"""Tracing of a message, or of every key at once, across topics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions import match_path
from topicspark.operators.scans import records_since, tail_records
from topicspark.operators.shared import BUCKET_MS, with_previous
from topicspark.operators.trace_blocks import may_hold


def trace_hits(
    log: DataFrame,
    key: str | None,
    path: str | None = None,
    regex: bool = False,
    minutes: int | None = None,
    as_of: datetime | None = None,
    n: int | None = None,
    topics: Sequence[str] | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Records that match ``key``.

    Every record of the (given) topics is searched.  ``minutes`` narrows the search to the time before ``as_of``;
    ``n`` to the newest ``n`` records of each topic (the oldest ``n`` of the time range).  With an ``index``
    (``trace_index``) only the blocks that may hold the key are searched; a regular expression, or ``n``, searches
    without it.
    """
    rows = log if topics is None else log.filter(F.col("topic").isin(list(topics)))
    if index is not None and key is not None and not regex and n is None:
        known = index if topics is None else index.filter(F.col("topic").isin(list(topics)))
        rows = may_hold(rows, known, key, path)
    if minutes is not None and minutes > 0:
        if as_of is None:
            raise ValueError("a trace over the last minutes needs `as_of`, the time they end at")
        rows = records_since(rows, minutes, n, as_of)
    elif n is not None:
        rows = tail_records(rows, n)
    hits = rows.filter(match_path("value", key, regex, path))
    return hits.select("topic", "partition", "offset", "timestamp")


def trace_nodes(hits: DataFrame) -> DataFrame:
    """One node per topic, numbered in order of its first hit."""
    first = F.min(F.struct("timestamp", "topic", "partition", "offset")).alias("first")
    topics = hits.groupBy("topic").agg(first)  # one row per topic from here on
    return topics.select(
        F.col("topic").alias("id"),
        F.col("topic").alias("label"),
        F.lit("topic").alias("type"),
        F.row_number().over(Window.orderBy("first")).alias("seq"),
    )


def _moves(hits: DataFrame, group: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Changes of topic in order of (timestamp, topic, partition, offset), within each group.

    Hits of one topic at one time follow each other, so one row stands for them; the combining before the shuffle
    keeps a bucket's size by its moments, however many hits it holds.
    """
    moments = hits.select(*group, "topic", F.unix_millis("timestamp").alias("at_ms")).distinct()
    here = F.struct("topic", "at_ms")
    ordered = with_previous(moments, group, "at_ms", ["at_ms", "topic"], here, "_before", bucket_ms)
    return ordered.filter(F.col("_before.topic") != F.col("topic")).select(
        *group,
        F.col("_before.topic").alias("from"),
        F.col("topic").alias("to"),
        F.timestamp_millis("_before.at_ms").alias("from_ts"),
        F.timestamp_millis("at_ms").alias("to_ts"),
    )


def trace_edges(hits: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """An edge for every hit in another topic than the hit before; repeats are kept, (to_ts, to) is their order.

    ``bucket_ms`` is the length of the time buckets the hits are split into: shorter where more topics are searched.
    """
    return _moves(hits, [], bucket_ms).select("from", "to", F.lit("flow").alias("label"), "from_ts", "to_ts")


def edge_counts(edges: DataFrame) -> DataFrame:
    """How often each edge occurs."""
    return edges.groupBy("from", "to").agg(F.count("*").alias("n"))


def trace_all(log: DataFrame, key_col: str = "key", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """The edges of every key at once; records without a key are left out.

    ``bucket_ms`` is the length of the time buckets a key's records are split into: shorter for hotter keys.
    """
    hits = log.select(F.col(key_col).alias("key"), "topic", "timestamp").filter("key IS NOT NULL")
    return _moves(hits, ["key"], bucket_ms)
