"""Repeated keys on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.model import LATENESS
from topicspark.streaming.windows import tumble


def duplicates_stream(
    stream: DataFrame, keys: Sequence[str], within: str | None = None, time_col: str = "event_time", lateness: str = LATENESS
) -> DataFrame:
    """Keys seen more than once, with how often.

    ``within`` counts repeats inside windows of that length: a window comes out once it is closed, in ``append`` mode, and
    its keys leave the state, which so stays bounded.  Without it repeats count over all time: run it in ``complete`` mode,
    on streams whose keys are bounded.
    """
    if within is not None:
        return tumble(stream, within, by=keys, time_col=time_col, lateness=lateness).filter("messages > 1")
    return stream.groupBy(*keys).agg(F.count("*").alias("messages")).filter("messages > 1")


def first_only(stream: DataFrame, keys: Sequence[str], time_col: str = "event_time", lateness: str = LATENESS) -> DataFrame:
    """The stream without repeats of a key inside the watermark."""
    if not stream.isStreaming:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(list(keys))
