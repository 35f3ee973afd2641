"""A stream joined with reference data that changes while it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from topicspark.operators.enrich import join_as_of


def start_reference_join(
    stream: DataFrame, changes: Callable[[SparkSession], DataFrame], key: str, at: str, since: str, target: str,
    checkpoint: str, how: str = "inner", name: str = "reference", every: str = "30 seconds", once: bool = False,
) -> StreamingQuery:
    """Write a stream's rows to Parquet below ``target`` with the reference data that held at their time.

    ``changes`` reads the reference again for each micro-batch, so a change counts from the next batch on without a
    restart; by its ``since`` it may hold for earlier times, but rows that are written already stay as they are.  A
    batch replaces its own folder, so one that is repeated after a failure comes once.  ``once`` stops after what is
    there now.  See ``join_as_of``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = batch.persist()
        try:
            joined = join_as_of(stored, changes(batch.sparkSession), key, at, since, how, name)
            joined.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch_id}")
        finally:
            stored.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
