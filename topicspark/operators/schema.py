"""Format and schema inference from samples, and the typed view of a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicspark.functions import json_field, value_format, xml_children
from topicspark.model import COLUMN_TYPES, LATENESS
from topicspark.operators.profile import json_type, merged_columns, scan_values, topic_facts
from topicspark.operators.scans import head_sample
from topicspark.operators.shared import checkpointed, join_by_topic


def _sample(log: DataFrame, n: int | None) -> DataFrame:
    return log.filter("value IS NOT NULL") if n is None else head_sample(log, n)


def _vote(samples: DataFrame) -> DataFrame:
    voted = samples.select("topic", value_format("value").alias("format"), F.struct("partition", "offset").alias("at"))
    return voted.filter("format IS NOT NULL").groupBy("topic").agg(F.min_by("format", "at").alias("format"))


def detect_format(log: DataFrame, n: int | None = None) -> DataFrame:
    """Format of each topic: that of its first value that looks like JSON or XML, else ``AUTO``.

    ``n`` looks at the first ``n`` records of each topic only, here as in the other inferences.
    """
    topics = log.select("topic").distinct()
    return topics.join(_vote(_sample(log, n)), "topic", "left").fillna("AUTO", ["format"])


def _json_columns(rows: DataFrame) -> DataFrame:
    """(topic, at, place, column, type) of each top-level field of each JSON value."""
    parsed = rows.select(
        "topic", "at", F.json_object_keys("value").alias("names"), F.try_parse_json("value").alias("doc")
    ).filter("doc IS NOT NULL AND schema_of_variant(doc) LIKE 'OBJECT%'")
    fields = parsed.lateralJoin(
        parsed.sparkSession.tvf.variant_explode(F.col("doc").outer()).select(
            F.col("key").alias("column"), F.schema_of_variant("value").alias("kind")
        )
    )
    return fields.select(
        "topic", "at", (F.array_position("names", F.col("column")) - 1).cast("int").alias("place"), "column",
        json_type(F.col("kind")).alias("type"),
    )


def _xml_columns(rows: DataFrame) -> DataFrame:
    """The same for the child elements of each XML value's root; all of them are text."""
    return rows.select("topic", "at", F.posexplode(xml_children("value")).alias("place", "column")).withColumn(
        "type", F.lit("STRING")
    )


def _columns(samples: DataFrame) -> DataFrame:
    """Merged columns of samples (topic, partition, offset, value, format)."""
    typed = samples.withColumn("at", F.struct("partition", "offset")).withColumn(
        "format", F.when(F.col("format") == "AUTO", value_format("value")).otherwise(F.col("format"))
    )
    found = _json_columns(typed.filter("format = 'JSON'")).unionByName(_xml_columns(typed.filter("format = 'XML'")))

    def seen(kind: str) -> Column:
        return F.bool_or(F.col("type") == kind)

    merged = found.groupBy("topic", "column").agg(
        F.min(F.struct("at", "place")).alias("first"),
        F.when(seen("STRING"), "STRING")
        .when(seen("DOUBLE"), "DOUBLE")
        .when(seen("BIGINT"), "BIGINT")
        .otherwise("BOOLEAN")
        .alias("type"),
    )
    place = F.row_number().over(Window.partitionBy("topic").orderBy("first")) - 1
    return merged.select("topic", place.alias("ordinal"), "column", "type")


def infer_schema(log: DataFrame, n: int | None = None, formats: DataFrame | None = None) -> DataFrame:
    """Columns of each topic over its samples, in order of first appearance, each with its widened type.

    ``formats`` (topic, format) is the format of each topic where it is known already.  The samples of a topic
    without a format are read each by its own first character.  Without ``n`` and ``formats`` the values are read once.
    """
    if n is None and formats is None:
        partial = scan_values(log, keys=False)
        return merged_columns(partial, topic_facts(partial))
    samples = _sample(log, n)
    if n is None:
        return _columns(join_by_topic(samples, formats))
    # Ten samples a topic: read once, then joined as they are.
    samples = checkpointed(samples)
    known = _vote(samples) if formats is None else formats
    return _columns(samples.join(known, "topic", "left").fillna("AUTO", ["format"]))


def topic_profile(
    log: DataFrame, n: int | None = None, strict: bool = False, topics: DataFrame | None = None
) -> DataFrame:
    """Format, key column and key type of each topic; one row per topic, computed once from one set of samples.

    ``topics`` lists the topics where that is known already.  Only JSON topics have a key column: the table over any
    other topic has no inferred columns.
    """
    if n is None:
        partial = scan_values(log, keys=False)
        facts = checkpointed(topic_facts(partial))
        return profile_of(facts, merged_columns(partial, facts), strict, topics)
    topics = log.select("topic").distinct() if topics is None else topics.select("topic")
    samples = checkpointed(_sample(log, n))
    voted = _vote(samples)
    formats = topics.join(voted, "topic", "left").fillna("AUTO", ["format"])
    columns = _columns(samples.join(voted, "topic", "left").fillna("AUTO", ["format"]))
    return profile_of(formats, columns, strict)


def profile_of(
    formats: DataFrame, columns: DataFrame, strict: bool = False, topics: DataFrame | None = None
) -> DataFrame:
    """The profile from formats and columns, checkpointed; ``topics`` adds topics without a message."""
    if topics is not None:
        formats = topics.select("topic").join(formats.select("topic", "format"), "topic", "left").fillna("AUTO", ["format"])
    is_json = F.col("format") == "JSON"
    return checkpointed(
        formats.join(find_key_field(columns, strict), "topic", "left").select(
            "topic",
            "format",
            F.when(is_json, F.col("key_field")).alias("key_field"),
            F.when(is_json, F.col("key_type")).alias("key_type"),
        )
    )


def find_key_field(schema_df: DataFrame, strict: bool = False) -> DataFrame:
    """Key column of each topic: ``id``, else the first of ``id``/``order_id`` in any case, else the first column.

    ``strict`` gives no key instead of falling back to the first column.
    """
    name = F.col("column")
    rank = F.when(name == "id", 0).when(F.lower(name).isin("id", "order_id"), 1)
    rank = rank if strict else rank.otherwise(2)
    order = F.struct(rank.alias("rank"), "ordinal")
    picked = F.min_by("column", F.when(rank.isNotNull(), order))
    return schema_df.groupBy("topic").agg(
        picked.alias("key_field"), F.min_by("type", F.when(rank.isNotNull(), order)).alias("key_type")
    )


def schema_struct(schema_df: DataFrame, topic: str) -> T.StructType:
    """The columns of one topic as a Spark schema.  A plan's columns must be known before it runs, so this reads them."""
    rows = schema_df.filter(F.col("topic") == topic).orderBy("ordinal").collect()
    return T.StructType([T.StructField(row["column"], COLUMN_TYPES[row["type"]]) for row in rows])


def topic_table(
    log: DataFrame, schema: T.StructType, format: str = "JSON", lateness: str = LATENESS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Typed view of a topic: its columns, the raw value, processing time, and event time with a watermark.

    Values that do not parse give nulls.  An XML topic has the raw value and the time columns only.  ``keep`` names
    further columns of the log to carry along.  A field whose name another column has already, in any case, gets its
    place in the schema after an underscore (``id``, ``ID`` become ``id``, ``ID_1``).
    """
    rows = log.withColumn("event_time", F.col("timestamp")).withWatermark("event_time", lateness)
    columns: list[Column] = []
    if format != "XML" and len(schema):
        names = [field.name.lower() for field in schema]
        alone = T.StructType([field for field in schema if names.count(field.name.lower()) == 1])
        rows = rows.withColumn("_row", F.from_json("value", alone, {"mode": "PERMISSIVE"}))
        taken = {"raw_value", "proc_time", "event_time", *(name.lower() for name in keep)}
        for place, field in enumerate(schema):
            if field in alone.fields:
                column = F.col("_row").getField(field.name)
            else:  # names that differ in case only
                column = json_field(F.col("value"), F.lit(field.name)).try_cast(field.dataType)
            name = field.name if field.name.lower() not in taken else f"{field.name}_{place}"
            taken.add(name.lower())
            columns.append(column.alias(name))
    return rows.select(
        *columns,
        F.col("value").alias("raw_value"),
        F.current_timestamp().alias("proc_time"),
        "event_time",
        *keep,
    )
