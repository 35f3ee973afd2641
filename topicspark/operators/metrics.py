"""SQL-defined metrics: evaluation, state, thresholds, history, and the registry kept as a log."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import (
    AnalysisException,
    ArithmeticException,
    ArrayIndexOutOfBoundsException,
    DateTimeException,
    IllegalArgumentException,
    NumberFormatException,
    ParseException,
    SparkRuntimeException,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicspark.model import HISTORY_CAP, METRICS_CONFIG_TOPIC
from topicspark.operators.metric_scan import PlainMetric, numbered, plain_metric, scan_metrics
from topicspark.operators.shared import checkpointed
from topicspark.plans.sql import run_sql

# What a query can do wrong; anything else is not the metric's fault.
QUERY_ERRORS = (
    AnalysisException, ParseException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException,
    IllegalArgumentException, NumberFormatException, SparkRuntimeException,
)

# The marker of a deleted metric, and what an empty result reports.
DELETED = "DELETED"
NO_ROWS = "No rows returned"

CONFIG = (
    "id STRING, name STRING, type STRING, sql STRING, description STRING, warningThreshold DOUBLE,"
    " criticalThreshold DOUBLE, lastValue DOUBLE, lastUpdateTime BIGINT, errorMessage STRING, history ARRAY<DOUBLE>"
)

# Metrics of an empty registry (id, name, type, SQL, description).
PRESETS = [
    (
        "business_events_total",
        "business_events_total",
        "COUNTER",
        "SELECT COUNT(*) AS metric_value FROM {events}",
        "Total number of business events processed",
    ),
    (
        "business_events_by_type",
        "business_events_by_type",
        "GAUGE",
        "SELECT COUNT(*) AS metric_value, 'order' AS type FROM {events} GROUP BY 'order'",
        "Events grouped by type",
    ),
]


def latest_by_key(log: DataFrame, tombstone: Column | None = None) -> DataFrame:
    """Last record of each key of each topic; keys whose last record is a tombstone are gone.

    Within a partition the offset decides, whatever the producers' clocks say; should a key be in several partitions,
    the latest of their last records counts.
    """
    per_partition = log.groupBy("topic", "key", "partition").agg(
        F.max(F.struct("offset", "timestamp", "value")).alias("r")
    )
    latest = per_partition.groupBy("topic", "key").agg(
        F.max(F.struct("r.timestamp", "partition", "r.offset", "r.value")).alias("last")
    )
    rows = latest.select("topic", "last.partition", "last.offset", "last.timestamp", "key", "last.value")
    return rows if tombstone is None else rows.filter(~F.coalesce(tombstone, F.lit(False)))


def metric_registry(log: DataFrame, topic: str = METRICS_CONFIG_TOPIC) -> DataFrame:
    """The saved metrics: the last configuration of each ID without the deleted ones, or the presets if none."""
    spark = log.sparkSession
    configs = (
        latest_by_key(log.filter(F.col("topic") == topic))
        .select(F.col("key"), F.from_json("value", CONFIG).alias("c"))
        .filter(~F.col("c.errorMessage").eqNullSafe(DELETED))
        .select(F.coalesce("c.id", "key").alias("id"), *[F.col(f"c.{f.name}") for f in _config_fields()[1:]])
    )
    presets = spark.createDataFrame(PRESETS, "id STRING, name STRING, type STRING, sql STRING, description STRING")
    for field in _config_fields()[5:]:
        presets = presets.withColumn(field.name, F.lit(None).cast(field.dataType))
    # An empty registry is one row's absence: no count, no cross join.
    saved = configs.limit(1).select(F.lit(1).alias("_one"))
    fallback = presets.withColumn("_one", F.lit(1)).join(saved, "_one", "left_anti").drop("_one")
    return configs.unionByName(fallback)


def _config_fields() -> list[T.StructField]:
    return T.StructType.fromDDL(CONFIG).fields


def eval_metric(spark: SparkSession, sql: str, max_rows: int | None = None, **frames: DataFrame) -> DataFrame:
    """Rows of a metric query: ``metric_value``, the other columns as labels, and the row's place.

    The query's column ``metric_value`` (in any case) is the value; rows without a number are left out.
    """
    result = run_sql(spark, sql, max_rows, **frames)
    value = F.lit(None).cast("double")
    labels: list[Column] = []
    for field in result.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.name.lower() == "metric_value":
            if isinstance(field.dataType, T.NumericType):
                value = column.cast("double")
        else:
            labels += [F.lit(field.name.lower()), F.coalesce(column.cast("string"), F.lit("null"))]
    named = F.create_map(*labels) if labels else F.create_map().cast("map<string,string>")
    # The query's own order counts; without one, that of the labels, so that a rerun numbers the rows alike.
    ordered = result._jdf.queryExecution().analyzed().getClass().getSimpleName() in ("Sort", "GlobalLimit")
    rows = result if ordered else result.orderBy(*[F.col(f"`{name}`").cast("string") for name in result.columns])
    numbered = rows.withColumn("_seq", F.monotonically_increasing_id())
    return numbered.select(value.alias("metric_value"), named.alias("labels"), F.col("_seq").alias("seq")).filter(
        "metric_value IS NOT NULL"
    )


def metric_status(
    value: Column | str, warning: Column | str, critical: Column | str, error: Column | str | None = None
) -> Column:
    """``red`` on error, ``unknown`` without a value, then ``red``, ``amber`` or ``green`` by the thresholds."""
    value, warning, critical = (F.col(c) if isinstance(c, str) else c for c in (value, warning, critical))
    failed = F.lit(False) if error is None else (F.col(error) if isinstance(error, str) else error).isNotNull()
    return (
        F.when(failed, F.lit("red"))
        .when(value.isNull(), F.lit("unknown"))
        .when(value >= critical, F.lit("red"))
        .when(value >= warning, F.lit("amber"))
        .otherwise(F.lit("green"))
    )


def metric_state(config: DataFrame, values: DataFrame) -> DataFrame:
    """Configurations after a refresh.

    ``values`` is (id, seq, metric_value, error, refreshed_at).  The first row's value is the metric's; an error keeps
    the last value; a metric whose rows hold neither value nor error stays as it is.  A new value is added to the end
    of ``history``, which keeps its last ``HISTORY_CAP`` values.
    """
    told = values.filter("metric_value IS NOT NULL OR error IS NOT NULL")
    primary = told.groupBy("id").agg(
        F.min_by("metric_value", F.when(F.col("metric_value").isNotNull(), F.col("seq"))).alias("new_value"),
        F.max("error").alias("new_error"),
        F.max("refreshed_at").alias("new_time"),
    )
    refreshed = F.col("new_time").isNotNull()
    longer = F.concat(F.coalesce("history", F.array().cast("array<double>")), F.array("new_value"))
    kept = F.slice(longer, F.greatest(F.size(longer) - HISTORY_CAP + 1, F.lit(1)), HISTORY_CAP)
    return config.join(primary, "id", "left").select(
        *[
            F.coalesce("new_value", "lastValue").alias("lastValue")
            if name == "lastValue"
            else F.coalesce(F.unix_millis("new_time"), "lastUpdateTime").alias("lastUpdateTime")
            if name == "lastUpdateTime"
            else F.when(refreshed, F.col("new_error")).otherwise(F.col("errorMessage")).alias("errorMessage")
            if name == "errorMessage"
            else F.when(F.col("new_value").isNull(), F.col("history")).otherwise(kept).alias("history")
            if name == "history"
            else F.col(name)
            for name in config.columns
        ]
    )


def metric_history(values: DataFrame, n: int = HISTORY_CAP) -> DataFrame:
    """Last ``n`` values of each metric, oldest first; ``values`` is (id, refreshed_at, metric_value)."""
    newest = Window.partitionBy("id").orderBy(F.desc("refreshed_at"), F.desc("metric_value"))
    kept = values.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("refreshed_at", "metric_value")))
    return kept.groupBy("id").agg(F.transform(ordered, lambda v: v["metric_value"]).alias("history"))


def refresh_metrics(
    spark: SparkSession, registry: DataFrame, frames: Mapping[str, DataFrame], as_of: datetime,
    max_rows: int | None = None,
) -> DataFrame:
    """Evaluate every metric of a registry once: (id, seq, metric_value, labels, error, refreshed_at).

    Query texts are needed on the driver to be planned; results stay with the executors.  Metrics that are one
    aggregate of a frame under a condition (``plain_metric``) share one scan of it; others run one by one.  A query
    that is wrong, or fails on its data, gives its metric an error row without touching the others: a scan that fails
    is done again for either half of its metrics.  A failure of the platform is raised.
    """
    plain: dict[str, list[PlainMetric]] = {}
    parts: list[DataFrame] = []
    # One row per metric that has none of its own.
    told: list[tuple] = []

    def failed(id_: str, error: Exception) -> None:
        told.append((id_, 0, None, None, str(error).split("\n", 1)[0], as_of))

    def alone(id_: str, sql: str) -> None:
        try:
            rows = checkpointed(eval_metric(spark, sql, max_rows, **frames))
            if rows.isEmpty() and _is_empty(spark, sql, frames):
                told.append((id_, 0, None, None, NO_ROWS, as_of))
            else:
                parts.append(rows.select(F.lit(id_).cast("string").alias("id"), "seq", "metric_value", "labels"))
        except (*QUERY_ERRORS, ValueError) as error:
            failed(id_, error)

    def together(frame: DataFrame, metrics: list[PlainMetric]) -> None:
        if len(metrics) == 1:
            alone(metrics[0].id, metrics[0].sql)
            return
        try:
            rows = numbered(scan_metrics(frame, metrics))
            seen = {row["id"] for row in rows.select("id").distinct().collect()}
        except QUERY_ERRORS:
            together(frame, metrics[: len(metrics) // 2])
            together(frame, metrics[len(metrics) // 2 :])
            return
        parts.append((rows if max_rows is None else rows.filter(F.col("seq") < max_rows)).filter("metric_value IS NOT NULL"))
        for metric in metrics:
            if metric.id in seen:
                continue
            if metric.grouped:
                told.append((metric.id, 0, None, None, NO_ROWS, as_of))
            elif metric.kind == "count":
                # Several groupings of an empty frame have no row, a count alone has one.
                told.append((metric.id, 0, 0.0, {name: text for name, _, text in metric.labels}, None, as_of))

    ids = set()
    for metric in registry.select("id", "sql").toLocalIterator():
        id_, sql = metric["id"], metric["sql"]
        try:
            schema = run_sql(spark, sql, None, **frames).schema
        except (*QUERY_ERRORS, ValueError) as error:
            failed(id_, error)
            continue
        # Rows of a shared scan are told apart by the metric's ID.
        found = None if id_ is None or id_ in ids else plain_metric(id_, sql, frames, schema)
        if found is None:
            alone(id_, sql)
        else:
            ids.add(id_)
            plain.setdefault(found.frame, []).append(found)
    for name, metrics in plain.items():
        together(frames[name], metrics)

    schema = (
        "id STRING, seq BIGINT, metric_value DOUBLE, labels MAP<STRING,STRING>, error STRING, refreshed_at TIMESTAMP"
    )
    rows = spark.createDataFrame(told, schema)
    for part in parts:
        valued = part.withColumn("error", F.lit(None).cast("string")).withColumn("refreshed_at", F.lit(as_of))
        rows = rows.unionByName(valued.select(*rows.columns))
    return rows


def _is_empty(spark: SparkSession, sql: str, frames: Mapping[str, DataFrame]) -> bool:
    return run_sql(spark, sql, 1, **frames).isEmpty()
