"""Topic audit: exact counts, repeated keys, malformed messages, health; and the report over all topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.functions import json_field, value_format, xml_ok
from topicspark.model import AUDIT_HISTORY_TOPIC
from topicspark.operators.metrics import latest_by_key
from topicspark.operators.profile import candidate_tallies, merged_columns, scan_values, topic_facts
from topicspark.operators.scans import sample_messages, topic_stats
from topicspark.operators.schema import profile_of, topic_profile
from topicspark.operators.shared import checkpointed, join_by_topic


COMMON_NAMES = 16


def exact_counts(log: DataFrame) -> DataFrame:
    """Messages of each topic, counted."""
    return log.groupBy("topic").agg(F.count("*").alias("message_count"))


def _typed_text(text: Column, kind: Column) -> Column:
    """Canonical text of a key, so that values equal under the column's type are equal; others stay as they are."""
    return (
        F.when(kind == "BIGINT", F.coalesce(text.try_cast("bigint").cast("string"), text))
        .when(kind == "DOUBLE", F.coalesce(text.try_cast("double").cast("string"), text))
        .when(kind == "BOOLEAN", F.coalesce(text.try_cast("boolean").cast("string"), text))
        .otherwise(text)
    )


def with_key_value(log: DataFrame, keys: DataFrame, stored: bool = False) -> DataFrame:
    """Add each record's value of its topic's key column, as text; ``keys`` is (topic, key_field[, key_type])."""
    if "key_type" not in keys.columns:
        keys = keys.withColumn("key_type", F.lit("STRING"))
    facts = keys.select("topic", "key_field", "key_type")
    facts = facts if stored else checkpointed(facts)
    joined = join_by_topic(log, facts, "left", stored=True)
    # A few names get paths of their own; of more, none does.
    named = facts.filter("key_field IS NOT NULL").select("key_field").distinct().limit(COMMON_NAMES + 1).collect()
    common = [row["key_field"] for row in named] if len(named) <= COMMON_NAMES else []
    value = json_field(F.col("value"), F.col("key_field"), common)
    found = F.when(F.col("key_field").isNotNull(), value)
    return joined.withColumn("key_value", _typed_text(found, F.col("key_type")))


def key_tallies(keyed: DataFrame, *also: str) -> DataFrame:
    """Messages per (topic, key value), combined before the shuffle: a hot key costs one row per task."""
    has_key = F.col("key_field").isNotNull().alias("has_key")
    return keyed.groupBy("topic", has_key, "key_value", *also).agg(F.count("*").alias("messages"))


def _key_counts(tallies: DataFrame) -> DataFrame:
    return tallies.groupBy("topic").agg(
        F.sum("messages").alias("message_count"),
        F.count_if((F.col("messages") > 1) & F.col("has_key")).alias("duplicate_count"),
    )


def duplicate_keys(log: DataFrame, keys: dict[str, str] | DataFrame) -> DataFrame:
    """Key values that occur more than once, counted per topic; null is one value; 0 where there is no key column.

    ``keys`` maps topics to key columns, or is a frame (topic, key_field[, key_type]).
    """
    if isinstance(keys, dict):
        keys = log.sparkSession.createDataFrame(list(keys.items()), "topic STRING, key_field STRING")
    return _key_counts(key_tallies(with_key_value(log, keys))).select("topic", "duplicate_count")


def poison_counts(
    log: DataFrame, formats: DataFrame, mode: str = "parse", n: int | None = None
) -> DataFrame:
    """Messages of each topic that contradict its format, all of them or the newest ``n``.

    ``parse`` parses the whole value; ``prefix`` looks at the first character.  Topics without a format have none.
    """
    formats = checkpointed(formats.select("topic", "format"))
    rows = log.filter("value IS NOT NULL") if n is None else sample_messages(log, n)
    rows = join_by_topic(rows, formats, stored=True) if n is None else rows.join(formats, "topic")
    if mode == "prefix":
        fits_json, fits_xml = value_format("value") == "JSON", value_format("value") == "XML"
    elif mode == "parse":
        fits_json = F.try_parse_json("value").isNotNull()
        fits_xml = xml_ok(F.when(F.col("format") == "XML", F.col("value")))
    else:
        raise ValueError(f"unknown poison mode {mode!r}; use 'prefix' or 'parse'")
    bad = F.when(F.col("format") == "JSON", ~F.coalesce(fits_json, F.lit(False))).when(
        F.col("format") == "XML", ~F.coalesce(fits_xml, F.lit(False))
    )
    counted = rows.groupBy("topic").agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("poison_count"))
    return formats.select("topic").join(counted, "topic", "left").fillna(0, ["poison_count"])


class ValueScan:
    """What one scan of the values gives an audit: ``profile``, ``tallies`` of the key columns, and ``poison``.

    ``tallies`` is (topic, has_key, key_value, messages), with ``at_ms`` if ``moments`` are kept; a null key value
    stands for the messages of a topic without a text in the key column.  Only topics whose key column is a first
    column that some value has in another place are read a second time.
    """

    def __init__(
        self, log: DataFrame, topics: DataFrame, strict: bool = False, moments: bool = False,
        partial: DataFrame | None = None,
    ):
        partial = scan_values(log, moments=moments) if partial is None else partial
        facts = checkpointed(topic_facts(partial))
        self.profile = profile_of(facts, merged_columns(partial, facts), strict, topics)
        self.poison = facts.select("topic", "poison_count")
        told, partly = candidate_tallies(partial, self.profile)
        partly = checkpointed(partly)
        again = partly.limit(1).count() > 0
        moment = ["at_ms"] if moments else []
        if again:
            told = told.join(partly, "topic", "left_anti")
        told = told.withColumn("key_value", _typed_text(F.col("key_text"), F.col("key_type")))
        told = told.groupBy("topic", "key_value", *moment).agg(F.sum("messages").alias("messages"))
        told = checkpointed(told) if moments else told
        count = told.groupBy("topic").agg(F.sum("messages").alias("told"))
        keyed = self.profile.select("topic", F.col("key_field").isNotNull().alias("has_key"))
        rest = facts.join(count, "topic", "left").join(keyed, "topic")
        if again:
            rest = rest.join(partly, "topic", "left_anti")
        untold = (F.col("message_count") - F.coalesce("told", F.lit(0))).alias("messages")
        nothing = [F.lit(None).cast("string").alias("key_value"), *[F.lit(None).cast("long").alias(m) for m in moment]]
        rest = rest.select("topic", "has_key", *nothing, untold).filter("messages > 0")
        tallies = told.withColumn("has_key", F.lit(True)).unionByName(rest)
        if again:
            values = log.withColumn("at_ms", F.unix_millis("timestamp")) if moments else log
            values = join_by_topic(values, partly.withColumn("_partly", F.lit(True)), stored=True).drop("_partly")
            keys = self.profile.join(partly, "topic", "left_semi")
            tallies = tallies.unionByName(key_tallies(with_key_value(values, keys), *moment))
        self.tallies = tallies


def _issues() -> Column:
    poison, repeated = F.col("poison_count"), F.col("duplicate_count")
    lost = (F.col("estimate") > 0) & (F.col("message_count") == 0)
    # Fixed texts: the first and the last.
    texts = F.array(
        F.when(
            poison > 0,
            F.concat(F.lit("Detected "), poison.cast("string"), F.lit(" malformed messages in sample.")),
        ),
        F.when(lost, F.lit("The broker reports messages, but none was read.")),
        F.when(
            repeated > 0,
            F.concat(F.lit("Detected "), repeated.cast("string"), F.lit(" potential duplicate records.")),
        ),
    )
    return F.array_compact(texts)


def audit_topics(
    log: DataFrame,
    sizes: DataFrame,
    profile: DataFrame,
    tallies: DataFrame,
    n: int | None = None,
    poison_mode: str = "parse",
    poison: DataFrame | None = None,
) -> DataFrame:
    """The audit rows, from sizes (topic, messages), a topic profile, and key tallies that other work may share.

    ``poison`` (topic, poison_count) is given where the malformed messages are counted already.
    """
    if poison is None:
        poison = poison_counts(log, profile, poison_mode, n)
    rows = sizes.withColumnRenamed("messages", "estimate").join(profile, "topic", "left")
    rows = rows.join(_key_counts(tallies), "topic", "left").join(poison, "topic", "left")
    rows = rows.fillna(0, ["message_count", "duplicate_count", "poison_count"]).fillna("AUTO", ["format"])
    return rows.withColumn("issues", _issues()).select(
        "topic",
        "message_count",
        "format",
        "poison_count",
        "duplicate_count",
        F.when(F.size("issues") == 0, "HEALTHY").otherwise("UNHEALTHY").alias("health"),
        "issues",
    )


def topic_audit(
    log: DataFrame,
    n: int | None = None,
    catalog: DataFrame | None = None,
    strict: bool = False,
    poison_mode: str = "parse",
    parts: DataFrame | None = None,
) -> DataFrame:
    """Audit of every topic: exact count, format, malformed samples, repeated keys, health and its reasons.

    ``catalog`` (topic, messages) is the broker's own list of topics and sizes; without it the log's offsets serve.
    Formats, key columns, malformed values and repeated keys come from all values; ``n`` takes formats and malformed
    values from samples of that size instead.  The values are read once; with ``parts``, the stored results of
    ``scan_values`` over the files of the log, united, they are not read at all.
    """
    sizes = checkpointed(topic_stats(log) if catalog is None else catalog)
    if n is None:
        scan = ValueScan(log, sizes, strict, partial=parts)
        poison = scan.poison if poison_mode == "parse" else None
        return audit_topics(log, sizes, scan.profile, scan.tallies, None, poison_mode, poison)
    profile = topic_profile(log, n, strict, sizes)
    tallies = key_tallies(with_key_value(log, profile, stored=True))
    return audit_topics(log, sizes, profile, tallies, n, poison_mode)


def audit_report(audit: DataFrame, flows: DataFrame, audit_id: str, total_messages: DataFrame | None = None) -> DataFrame:
    """One row: totals, unhealthy topics, and the audited topics and flows (one element per topic) as arrays.

    ``total_messages`` (topic, messages) gives the sizes by offsets; without it the exact counts are summed.
    """
    topics = F.struct(
        F.col("topic").alias("name"), "message_count", "format", "poison_count", "duplicate_count", "health", "issues"
    )
    totals = audit.agg(
        F.lit(audit_id).alias("audit_id"),
        F.lit("COMPLETED").alias("status"),
        F.count("*").alias("total_topics"),
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("total_messages"),
        F.count_if(F.col("health") == "UNHEALTHY").alias("unhealthy_topics"),
        F.sort_array(F.collect_list(topics)).alias("topic_audits"),
        F.lit(1).alias("_one"),
    )
    step = F.struct("flow", "ordinal", "topic", "message_count", "throughput_pct", "avg_latency_ms", "health_score")
    steps = flows.agg(F.sort_array(F.collect_list(step)).alias("flow_steps"), F.lit(1).alias("_one"))
    report = totals.join(steps, "_one").drop("_one")
    if total_messages is not None:
        sizes = total_messages.agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("total_messages"), F.lit(1).alias("_one"))
        report = report.drop("total_messages").withColumn("_one", F.lit(1)).join(sizes, "_one").drop("_one")
    return report.withColumn("stats", F.create_map(F.lit("timestamp"), F.unix_millis(F.current_timestamp())))


AUDIT_RECORD = (
    "audit_id STRING, status STRING, total_topics BIGINT, total_messages BIGINT, unhealthy_topics BIGINT,"
    " topic_audits ARRAY<STRUCT<name: STRING, message_count: BIGINT, format: STRING, poison_count: BIGINT,"
    " duplicate_count: BIGINT, health: STRING, issues: ARRAY<STRING>>>,"
    " flow_steps ARRAY<STRUCT<flow: STRING, ordinal: INT, topic: STRING, message_count: BIGINT,"
    " throughput_pct: DOUBLE, avg_latency_ms: BIGINT, health_score: DOUBLE>>, stats MAP<STRING, BIGINT>"
)


def audit_history(log: DataFrame, topic: str = AUDIT_HISTORY_TOPIC) -> DataFrame:
    """Past audit reports with their topics and flows, one row per audit ID: the last record written for it."""
    latest = latest_by_key(log.filter(F.col("topic") == topic))
    return latest.select(F.from_json("value", AUDIT_RECORD).alias("r"), F.col("timestamp").alias("written_at")).select(
        "r.*", "written_at"
    )
