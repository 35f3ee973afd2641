"""Metrics kept up to date by their partial aggregates: a new batch is merged in, nothing is read twice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_VERSION = "_version"
KINDS = ("count", "sum", "min", "max", "avg")


class MetricView:
    """Aggregates of rows by ``by``, as partial results that can be merged.

    ``aggs`` maps a result's name to (kind, column); the kind is one of ``count``, ``sum``, ``min``, ``max`` and
    ``avg``, the column is null for a count of rows.  Nulls are passed over, as in SQL.  An average is kept as a sum and a
    count.  An aggregate that cannot be put together from parts (a median, a distinct count) has no place here: run its
    query again with ``refresh_metrics``.
    """

    def __init__(self, by: Sequence[str], aggs: Mapping[str, tuple[str, str | None]]):
        for kind, column in aggs.values():
            if kind not in KINDS or (column is None and kind != "count"):
                raise ValueError(f"not an aggregate that can be merged: {kind!r} of {column!r}")
        self.by, self.aggs = list(by), dict(aggs)

    def _parts(self) -> list[tuple[str, str, Column]]:
        """Name, merging function and first form of each partial result."""
        out = []
        for name, (kind, column) in self.aggs.items():
            value = F.lit(1) if column is None else F.col(f"`{column}`")
            if kind == "avg":
                out += [(f"{name}_sum", "sum", F.sum(value.cast("double"))), (f"{name}_n", "sum", F.count(value))]
            elif kind == "count":
                out.append((f"{name}_n", "sum", F.count(value)))
            else:
                out.append((f"{name}_{kind}", kind, getattr(F, kind)(value)))
        return out

    def partial(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.by).agg(*[first.alias(name) for name, _, first in self._parts()])

    def merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.by).agg(*[getattr(F, merge)(name).alias(name) for name, merge, _ in self._parts()])

    def final(self, parts: DataFrame) -> DataFrame:
        """``by`` and the results, from merged parts."""
        out = []
        for name, (kind, _) in self.aggs.items():
            if kind == "avg":
                out.append(F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n")).alias(name))
            else:
                out.append(F.col(f"{name}_n" if kind == "count" else f"{name}_{kind}").alias(name))
        return parts.select(*self.by, *out)

    def _stored(self, spark: SparkSession, state: str, half: int) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{state.rstrip('/')}/half={half}/*.parquet")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def refresh(self, batch: DataFrame, batch_id: int, state: str) -> None:
        """Merge a batch into the state: that of the batch before is read from one half, this one's goes to the other.

        A batch that is repeated after a failure starts from the same state and gives the same, so nothing counts
        twice; the state takes two rows per group, however many batches there were.
        """
        spark = batch.sparkSession
        parts = self.partial(batch)
        before = self._stored(spark, state, (batch_id - 1) % 2) if batch_id else None
        if before is not None:
            parts = self.merged(before.filter(F.col(_VERSION) == batch_id - 1).drop(_VERSION).unionByName(parts))
        versioned = parts.withColumn(_VERSION, F.lit(batch_id).cast("long"))
        versioned.write.mode("overwrite").parquet(f"{state.rstrip('/')}/half={batch_id % 2}")

    def read(self, spark: SparkSession, state: str) -> DataFrame | None:
        """The results as of the last batch merged; None before the first."""
        halves = [half for half in (self._stored(spark, state, i) for i in (0, 1)) if half is not None]
        if not halves:
            return None
        versions = [half.agg(F.max(_VERSION)).first()[0] for half in halves]
        newest = max(range(len(halves)), key=lambda i: -1 if versions[i] is None else versions[i])
        return self.final(halves[newest].drop(_VERSION))


def start_metric(
    stream: DataFrame, view: MetricView, state: str, checkpoint: str, every: str = "30 seconds", once: bool = False
) -> StreamingQuery:
    """Keep a view up to date with a stream, one merge per micro-batch; ``once`` stops after what is there now."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        view.refresh(batch, batch_id, state)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
