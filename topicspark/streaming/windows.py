"""Event-time windows; the same calls work on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.model import LATENESS

STRETCH = 1 << 14  # tiles that are chained in one task where sessions have no keys


def _windowed(df, window, by, aggs, time_col, lateness) -> DataFrame:
    rows = df.withWatermark(time_col, lateness) if df.isStreaming else df
    by = list(by)
    grouped = rows.groupBy(window.alias("_window"), *by)
    counted = grouped.agg(*(aggs or [F.count("*").alias("messages")]))
    results = [name for name in counted.columns if name != "_window"]
    return counted.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *results
    )


def tumble(
    df: DataFrame, size: str, by: Sequence[str] = (), aggs: Sequence[Column] = (), time_col: str = "event_time",
    lateness: str = LATENESS,
) -> DataFrame:
    """Fixed windows of ``size`` (such as ``"1 hour"``); without ``aggs`` the messages are counted."""
    return _windowed(df, F.window(time_col, size), by, aggs, time_col, lateness)


def hop(
    df: DataFrame, size: str, slide: str, by: Sequence[str] = (), aggs: Sequence[Column] = (),
    time_col: str = "event_time", lateness: str = LATENESS,
) -> DataFrame:
    """Overlapping windows of ``size``, one starting every ``slide``."""
    return _windowed(df, F.window(time_col, size, slide), by, aggs, time_col, lateness)


def _started(tiles: DataFrame, by: list[str], gap_us: Column) -> DataFrame:
    """Tiles with the begin of their session, within each group of ``by``."""
    ordered = Window.partitionBy(*by).orderBy("_tile")
    opens = F.coalesce(F.col("_from") - F.lag("_to").over(ordered) > gap_us, F.lit(True))
    start = F.last(F.when(F.col("_opens"), F.col("_from")), ignorenulls=True)
    return tiles.withColumn("_opens", opens).withColumn("_start", start.over(ordered)).drop("_opens")


def _started_in_stretches(tiles: DataFrame, gap_us: Column) -> DataFrame:
    """The same without groups: tiles are chained within stretches of ``STRETCH`` tiles, each in a task of its own, and
    the stretches' ends, one row each, are chained after that."""
    tiles = tiles.withColumn("_stretch", F.floor(F.col("_tile") / STRETCH).cast("bigint"))
    local = _started(tiles, ["_stretch"], gap_us).withColumnRenamed("_start", "_begun")
    ends = local.groupBy("_stretch").agg(
        F.min("_from").alias("_first"), F.max("_to").alias("_last"), F.max("_begun").alias("_last_begun")
    )
    ordered = Window.orderBy("_stretch")
    joins = F.coalesce(F.col("_first") - F.lag("_last").over(ordered) <= gap_us, F.lit(False))
    known = F.when(F.col("_last_begun") > F.col("_first"), F.col("_last_begun")).when(~F.col("_joins"), F.col("_first"))
    ends = ends.withColumn("_joins", joins).withColumn("_open", F.last(known, ignorenulls=True).over(ordered))
    entered = F.when(F.col("_joins"), F.lag("_open").over(ordered)).otherwise(F.col("_first"))
    ends = ends.withColumn("_entered", entered).select("_stretch", "_first", "_entered")
    start = F.when(F.col("_begun") == F.col("_first"), F.col("_entered")).otherwise(F.col("_begun"))
    return local.join(ends, "_stretch").withColumn("_start", start).drop("_stretch", "_begun", "_first", "_entered")


def session(
    df: DataFrame, gap: str, by: Sequence[str] = (), aggs: Sequence[Column] = (), time_col: str = "event_time",
    lateness: str = LATENESS,
) -> DataFrame:
    """Windows that end when no message comes within ``gap``; one exactly that late still belongs.

    On a batch, records of one group in the same tile of the gap's length are in the same session.  So tiles are
    counted first, combined before the shuffle, and sessions are put together from tiles; a hot key costs one row per
    tile.  Without keys the tiles are chained stretch by stretch, and one task sees a row per stretch.  Own ``aggs`` then run per session over the records, which meet their tile's session by key and tile.
    """
    if df.isStreaming:
        return _windowed(df, F.session_window(time_col, gap), by, aggs, time_col, lateness)
    by = list(by)
    gap_us = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {gap})")
    rows = df.filter(F.col(time_col).isNotNull()).withColumn("_us", F.unix_micros(time_col))
    rows = rows.withColumn("_tile", F.floor(F.col("_us") / gap_us).cast("bigint"))
    tiles = rows.groupBy(*by, "_tile").agg(
        F.min("_us").alias("_from"), F.max("_us").alias("_to"), F.count("*").alias("messages")
    )
    started = _started(tiles, by, gap_us) if by else _started_in_stretches(tiles, gap_us)
    bounds = [
        F.timestamp_micros("_start").alias("window_start"),
        F.timestamp_micros(F.max("_to") + gap_us).alias("window_end"),
    ]
    if not aggs:
        sessions = started.groupBy(*by, "_start").agg(bounds[1], F.sum("messages").alias("messages"))
        return sessions.select(bounds[0], "window_end", *by, "messages")
    same = [rows[name].eqNullSafe(started[name]) for name in [*by, "_tile"]]
    placed = rows.join(started.select(*by, "_tile", "_start"), same).select(rows["*"], "_start")
    counted = placed.groupBy(*by, "_start").agg(F.max("_us").alias("_to"), *aggs)
    results = [name for name in counted.columns if name not in ("_start", "_to", *by)]
    return counted.select(
        bounds[0], F.timestamp_micros(F.col("_to") + gap_us).alias("window_end"), *by, *results
    )
