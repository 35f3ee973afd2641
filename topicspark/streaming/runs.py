"""Starting streaming queries, and running one over what is there now."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from topicspark.operators.shared import checkpoint_root
from topicspark.sources import write_log


def start_insert(
    stream: DataFrame, target: str, checkpoint: str, mode: str = "append", format: str = "parquet",
    options: dict[str, str] | None = None, once: bool = False,
) -> StreamingQuery:
    """Long-running ``INSERT INTO target SELECT ..``: a path for file formats, a topic for ``kafka``.

    ``once`` stops after what is there now.
    """
    writer = stream.writeStream.format(format).outputMode(mode).options(**(options or {}))
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.option("topic", target).start() if format == "kafka" else writer.start(target)


def start_log_insert(
    stream: DataFrame, key: str, topic: str, sink: str, checkpoint: str, name: str, partitions: int = 4, once: bool = False
) -> StreamingQuery:
    """Append a stream's rows to a log as keyed records, each exactly once.

    A micro-batch is written under ``name`` and its number, so one that is repeated after a failure adds nothing.  A
    query that starts from a new checkpoint needs a new name.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_log(batch, key, topic, sink, partitions=partitions, batch=f"{name}-{batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_refresh(
    stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds"
) -> StreamingQuery:
    """Call ``refresh(batch, batch_id)`` on the new records every interval: the continuous form of a batch product.

    A batch belongs to the stream's own session: SQL inside ``refresh`` goes to ``batch.sparkSession``.
    """
    return (
        stream.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def run_available_now(stream: DataFrame, mode: str = "complete", keys: Sequence[str] | None = None) -> DataFrame:
    """Run a streaming query over all that its sources hold now, stop, and return what it wrote.

    In ``update`` mode ``keys`` names the columns by which a later batch's row replaces an earlier one.
    Each micro-batch replaces its own folder below the shared checkpoint folder, so a repeated batch changes nothing.
    """
    if mode == "update" and not keys:
        raise ValueError("mode='update' needs `keys`, the columns that tell a row's later version")
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    written: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
        written.append(batch_id)

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    if mode == "update":
        schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
        rows = spark.read.schema(schema).parquet(f"{base}/out")
        columns = F.struct(*[field.name for field in stream.schema.fields])
        last = rows.groupBy(*keys).agg(F.max_by(columns, "batch").alias("_last"))
        return last.select("_last.*")
    kept = written if mode == "append" else written[-1:]
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/batch={batch_id}" for batch_id in sorted(set(kept))])


def read_bounded(stream: DataFrame, rows: int | None = None, seconds: float | None = None) -> DataFrame:
    """The first results of a running query: it is stopped after ``rows`` rows or ``seconds``, whichever comes first.

    The cut lies between micro-batches, so it is the same however the query is timed: with ``rows``, the batch that
    reaches the number is the last, and given whole (``limit`` cuts further).  What a batch had written when the time
    was up, but not finished, is left out.  A failure of the query is raised.
    """
    if rows is None and seconds is None:
        raise ValueError("a bounded read needs `rows` or `seconds`")
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    finished: list[tuple[str, int]] = []

    def enough() -> bool:
        return rows is not None and sum(n for _, n in finished) >= rows

    def write(batch: DataFrame, batch_id: int) -> None:
        if enough():
            return
        folder = f"{base}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        finished.append((folder, batch.sparkSession.read.schema(stream.schema).parquet(folder).count()))

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").start()
    ends = None if seconds is None else time.monotonic() + seconds
    try:
        # Returns early when the query ends by itself, and raises its failure.
        while not enough() and (ends is None or time.monotonic() < ends) and not query.awaitTermination(0.1):
            pass
    finally:
        query.stop()
    if not finished:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[folder for folder, _ in finished])
