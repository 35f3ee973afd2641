"""Latency between two steps as a stream-stream join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.model import LATENESS


def step_latency_stream(
    stream_a: DataFrame, stream_b: DataFrame, key: str, max_gap: str, lateness: str = LATENESS,
    time_col: str = "event_time",
) -> DataFrame:
    """Delay of each record of B after each record of A with the same key, up to ``max_gap``; streams or batches.

    The gap and the two watermarks bound the state; records without a key match nothing.  A key's records are spread
    over time slots as long as the gap: a match lies in the slot of A's record or in the next one, so A's records
    stand in both and the join is on key and slot.  No key's whole history meets in one task.
    """
    gap = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {max_gap})")

    def side(stream: DataFrame, name: str) -> DataFrame:
        rows = stream.select(F.col(key).alias(f"key_{name}"), F.col(time_col).alias(f"ts_{name}"))
        rows = rows.filter(F.col(f"key_{name}").isNotNull())
        rows = rows.withWatermark(f"ts_{name}", lateness) if stream.isStreaming else rows
        return rows.withColumn(f"slot_{name}", F.floor(F.unix_micros(f"ts_{name}") / gap).cast("bigint"))

    a = side(stream_a, "a").withColumn("slot_a", F.explode(F.array(F.col("slot_a"), F.col("slot_a") + 1)))
    later = F.expr(f"key_a = key_b AND slot_a = slot_b AND ts_b > ts_a AND ts_b <= ts_a + INTERVAL {max_gap}")
    return a.join(side(stream_b, "b"), later).select(
        F.col("key_a").alias("key"),
        "ts_a",
        "ts_b",
        (F.unix_millis("ts_b") - F.unix_millis("ts_a")).alias("latency_ms"),
    )
