"""Process flows read from topic names: throughput, drop-off and latency from step to step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.operators.audit import ValueScan, audit_topics, key_tallies, with_key_value
from topicspark.operators.scans import topic_stats
from topicspark.operators.schema import topic_profile
from topicspark.operators.shared import BUCKET_MS, checkpointed, dealt, join_by_topic


def _steps(topics: DataFrame) -> DataFrame:
    """(flow, ordinal, ..) of topics whose first two name parts they share with another topic."""
    flow = F.concat_ws(".", F.slice(F.split("topic", r"\."), 1, 2))
    named = topics.filter(F.col("topic").contains(".")).withColumn("flow", flow)
    whole = Window.partitionBy("flow")
    return (
        named.withColumn("_size", F.count("*").over(whole))
        .filter("_size >= 2")
        .withColumn("ordinal", F.row_number().over(whole.orderBy("topic")))
        .drop("_size")
    )


def flow_steps(audit: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Steps of each flow in topic-name order, with throughput against the first step and loss against the last.

    ``skip_empty`` leaves topics without messages out.  The frame has one row per topic.
    """
    counted = audit.select("topic", "message_count")
    if skip_empty:
        counted = counted.filter("message_count > 0")
    ordered = Window.partitionBy("flow").orderBy("ordinal")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("message_count").over(whole)
    throughput = F.when(first == 0, F.lit(100.0)).otherwise(
        F.try_divide(F.col("message_count").cast("double"), first.cast("double")) * 100.0
    )
    return (
        _steps(counted)
        .withColumn("throughput_pct", throughput)
        .withColumn("drop_off", F.lag("message_count").over(ordered) - F.col("message_count"))
        .withColumn("health_score", F.last("throughput_pct").over(whole))
        .select("flow", "ordinal", "topic", "message_count", "throughput_pct", "drop_off", "health_score")
    )


def _wide(col: Column) -> Column:
    """Whole number wide enough for sums of milliseconds over pairs."""
    return col.cast("decimal(38,0)")


def _pair_latency(moments: DataFrame, rows: int) -> DataFrame:
    """Mean delay over all pairs (earlier record of the step before, later record of the step) with the same key.

    ``moments``, about ``rows`` of them, is (flow, ordinal, last, key_value, at_ms, messages), one row per distinct moment of a step's key.
    The pairs of a key are never formed: the sum of the differences to all earlier records follows from how many
    there are and from the sum of their times.  A key's time line is cut into buckets; a bucket adds the pairs inside
    it and, with the running totals of the buckets before it, the pairs that cross into it.  So a task holds one
    bucket of one key, at most as many rows as the bucket has milliseconds, and then a key's buckets; tasks of many
    small ones get about as many rows whatever the input is.
    """
    none = F.lit(0).cast("bigint")
    step = ["flow", "ordinal"]
    line = [*step, "key_value"]
    columns = [*line, "at_ms", "before", "after"]
    # A step's records are sources of the next step and targets of their own.
    source = moments.filter(~F.col("last")).withColumn("ordinal", F.col("ordinal") + 1).withColumn("after", none)
    target = moments.filter("ordinal > 1").withColumn("before", none)
    roles = source.withColumnRenamed("messages", "before").select(*columns).union(
        target.withColumnRenamed("messages", "after").select(*columns)
    )
    ticks = roles.withColumn("bucket", F.expr(f"at_ms div {BUCKET_MS}")).withColumn("tick", F.expr(f"at_ms % {BUCKET_MS}"))
    ticks = dealt(ticks, 2 * rows, *line, "bucket")
    before, after, tick, bucket, n = (F.col(name) for name in ("before", "after", "tick", "bucket", "n"))

    earlier = Window.partitionBy(*line, "bucket").orderBy("tick").rangeBetween(Window.unboundedPreceding, -1)
    seen = ticks.withColumn("before_ticks", before * tick).select(
        "*",
        F.coalesce(F.sum("before").over(earlier), none).alias("n"),
        F.coalesce(F.sum("before_ticks").over(earlier), none).alias("ticks"),
    )
    meets = (after > 0) & (n > 0)
    inside = seen.groupBy(*line, "bucket").agg(
        F.sum("before").alias("before"),
        F.sum("before_ticks").alias("before_ticks"),
        F.sum("after").alias("after"),
        F.sum(after * tick).alias("after_ticks"),
        F.sum(F.when(meets, _wide(after) * _wide(n))).alias("pairs"),
        F.sum(F.when(meets, _wide(after) * _wide(n * tick - F.col("ticks")))).alias("delay"),
    )
    past = Window.partitionBy(*line).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    crossing = dealt(inside, 2 * rows, *line).withColumn("before_buckets", before * bucket).select(
        "*",
        F.coalesce(F.sum("before").over(past), none).alias("n"),
        F.coalesce(F.sum("before_ticks").over(past), none).alias("ticks"),
        F.coalesce(F.sum("before_buckets").over(past), none).alias("buckets"),
    )
    # Σ over crossing pairs of (target time − source time), in buckets and in ticks within them.
    whole = _wide(after * bucket) * _wide(n) - _wide(after) * _wide(F.col("buckets"))
    rest = _wide(F.col("after_ticks")) * _wide(n) - _wide(after) * _wide(F.col("ticks"))
    return (
        crossing.groupBy(*step)
        .agg(
            F.sum(F.when(meets, _wide(after) * _wide(n))).alias("crossing_pairs"),
            F.sum(F.when(meets, _wide(_wide(whole) * _wide(F.lit(BUCKET_MS)) + _wide(rest)))).alias("crossing_delay"),
            F.sum("pairs").alias("pairs"),
            F.sum("delay").alias("delay"),
        )
        .fillna(0)
        .withColumn("pairs", F.col("pairs") + F.col("crossing_pairs"))
        .withColumn("delay", F.col("delay") + F.col("crossing_delay"))
        .filter("pairs > 0")
        .select(*step, F.expr("CAST(delay div pairs AS BIGINT)").alias("avg_latency_ms"))
    )


def _latency_of(tallies: DataFrame, steps: DataFrame) -> DataFrame:
    """Latency of each step from stored (topic, key_value, at_ms, messages); null for first steps and unmatched ones."""
    steps = steps.select("flow", "ordinal", "topic")
    last = F.col("ordinal") == F.max("ordinal").over(Window.partitionBy("flow"))
    moments = join_by_topic(tallies.filter("key_value IS NOT NULL"), steps.withColumn("last", last))
    return steps.join(_pair_latency(moments, tallies.count()), ["flow", "ordinal"], "left")


def step_latency(log: DataFrame, steps: DataFrame, key: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Mean time, in whole milliseconds, from the step before to each step, over records with equal keys.

    ``key`` is a column of the log; without it ``keys`` (topic, key_field[, key_type]), or else each topic's inferred
    key column, is used.
    """
    at_ms = F.unix_millis("timestamp")
    if key is not None:
        keyed = log.select("topic", F.col(key).cast("string").alias("key_value"), at_ms.alias("at_ms"))
    else:
        keyed = with_key_value(log, topic_profile(log) if keys is None else keys).withColumn("at_ms", at_ms)
    moments = keyed.groupBy("topic", "key_value", "at_ms").agg(F.count("*").alias("messages"))
    return _latency_of(checkpointed(moments), steps)


def flow_audit(
    log: DataFrame, n: int | None = None, skip_empty: bool = False, audit: DataFrame | None = None,
    catalog: DataFrame | None = None, parts: DataFrame | None = None,
) -> DataFrame:
    """Every flow's steps with counts, throughput, loss, latency and the flow's health.

    ``catalog`` (topic, messages) is the broker's list of topics: with it a step that has no message is a step too,
    unless ``skip_empty``.  The keys are read from the values once; their tallies are stored, and feed the counts and
    the latencies.  With ``parts``, the stored results of ``scan_values`` with moments, the values are not read at all.
    """
    sizes = checkpointed(topic_stats(log) if catalog is None else catalog.select("topic", "messages"))
    if n is None:
        scan = ValueScan(log, sizes, moments=True, partial=parts)
        profile, tallies, poison = scan.profile, scan.tallies, scan.poison
    else:
        profile, poison = topic_profile(log, n, topics=sizes), None
        keyed = with_key_value(log, profile, stored=True).withColumn("at_ms", F.unix_millis("timestamp"))
        tallies = checkpointed(key_tallies(keyed, "at_ms"))
    if audit is None:
        # Steps come from names alone, so finding them does not run the audit.
        named = sizes.filter("messages > 0") if skip_empty else sizes
        layout = _steps(named.select("topic"))
        per_key = tallies.groupBy("topic", "has_key", "key_value").agg(F.sum("messages").alias("messages"))
        audit = audit_topics(log, sizes, profile, per_key, n, poison=poison)
    else:
        layout = flow_steps(audit, skip_empty)
    steps = flow_steps(audit, skip_empty)
    latency = _latency_of(tallies, layout).select("topic", "avg_latency_ms")
    return steps.join(latency, "topic", "left").select(
        "flow", "ordinal", "topic", "message_count", "throughput_pct", "drop_off", "avg_latency_ms", "health_score"
    )
