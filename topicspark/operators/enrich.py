"""Rows with the reference data that held at their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.operators.shared import BROADCAST_ROWS, checkpointed, with_previous

_HOUR_US = 3_600_000_000


def valid_spans(changes: DataFrame, key: str, since: str) -> DataFrame:
    """(_key, _since, _until, _fact): each change of a key holds from its time, in microseconds, until the next one's.

    ``_fact`` is a struct of the change's columns; ``_until`` is null for a key's last change.  Of several changes of
    one key at one time the greatest by column order counts.  Changes without a key or a time hold never.  A key's
    changes are cut by hours, so one that changes all the time does not fill a task.
    """
    fact = F.struct(*[F.col(f"`{name}`") for name in changes.columns])
    told = changes.select(F.col(f"`{key}`").alias("_key"), F.unix_micros(f"`{since}`").alias("_since"), fact.alias("_fact"))
    once = told.filter("_key IS NOT NULL AND _since IS NOT NULL").groupBy("_key", "_since").agg(F.max("_fact").alias("_fact"))
    # The next change is the previous one of a time that runs backwards.
    backwards = once.withColumn("_back", -F.col("_since"))
    spans = with_previous(backwards, ["_key"], "_back", ["_back"], F.col("_since"), "_until", _HOUR_US)
    return spans.select("_key", "_since", "_until", "_fact")


def join_as_of(
    rows: DataFrame, changes: DataFrame, key: str, at: str, since: str, how: str = "inner", name: str = "reference"
) -> DataFrame:
    """``rows`` with the change of their key that held at their time, as a struct column ``name``.

    A change holds at its own time already.  ``how="left"`` keeps rows without one, with null; a null key or time has
    none.  Every row comes once at most.  Changes that held at no time between the first and the last row are left out
    before the join; what remains is stored, and broadcast only where it has at most ``BROADCAST_ROWS`` rows.  Beyond
    that the join is on the key, and a key with very many rows is split as Spark splits skewed joins: each of its rows
    is compared with the key's changes within that time.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how!r}; use 'inner' or 'left'")
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name!r} already; give another `name`")
    placed = rows.withColumn("_at", F.unix_micros(f"`{at}`"))
    first, last = placed.agg(F.min("_at"), F.max("_at")).first()
    spans = valid_spans(changes, key, since)
    if first is None:
        spans = spans.limit(0)
    else:
        spans = spans.filter((F.col("_since") <= last) & (F.col("_until").isNull() | (F.col("_until") > first)))
    spans = checkpointed(spans)
    if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    holds = (F.col(f"`{key}`") == F.col("_key")) & (F.col("_at") >= F.col("_since"))
    holds &= F.col("_until").isNull() | (F.col("_at") < F.col("_until"))
    joined = placed.join(spans, holds, how)
    return joined.select(*[F.col(f"`{column}`") for column in rows.columns], F.col("_fact").alias(name))
