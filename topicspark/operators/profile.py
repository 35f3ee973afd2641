"""One scan of the values for all that audits and schemas need, as partial results that can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions import json_field, value_format
from topicspark.functions.xml_values import xml_outline
from topicspark.operators.shared import checkpointed, join_by_topic

# Types of a column as bits, so that a group's types are one number.
_TYPES = {"BOOLEAN": 1, "BIGINT": 2, "DOUBLE": 4, "STRING": 8}
# Names of key columns, in lower case; without one of them the first column is the key.
KEY_NAMES = ("id", "order_id")
_WIDE_INTEGER = r"^DECIMAL\((19|[23]\d),0\)$"
_OFFSETS, _PLACES = "10000000000000000000", "1000000"


def _wide(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def _spot() -> Column:
    """Partition and offset as one number: it orders like them, and a hash aggregation can hold it."""
    return _wide(_wide(F.col("partition")) * F.lit(_OFFSETS).cast("decimal(20,0)") + _wide(F.col("offset")))


def _spot_in(place: str) -> Column:
    """The same with the place within the value."""
    return _wide(F.col("at") * F.lit(_PLACES).cast("decimal(7,0)") + _wide(F.col(place)))


def json_type(kind: Column) -> Column:
    """Column type of a JSON value, from its variant type.

    A variant keeps ``10.0`` as a decimal without fraction digits; only integers wider than 18 digits stay text.
    """
    wide_integer = kind.rlike(_WIDE_INTEGER)
    return (
        F.when(kind == "BIGINT", F.lit("BIGINT"))
        .when((kind == "DOUBLE") | (kind.startswith("DECIMAL") & ~wide_integer), F.lit("DOUBLE"))
        .when(kind == "BOOLEAN", F.lit("BOOLEAN"))
        .otherwise(F.lit("STRING"))
    )


def _bit(kind: Column) -> Column:
    """The bit of a JSON value's column type, in one look at each kind."""
    number = (kind == "DOUBLE") | (kind.startswith("DECIMAL") & ~kind.rlike(_WIDE_INTEGER))
    bit = F.when(kind == "BIGINT", _TYPES["BIGINT"]).when(number, _TYPES["DOUBLE"]).when(kind == "BOOLEAN", _TYPES["BOOLEAN"])
    return bit.otherwise(_TYPES["STRING"]).cast("int")


def _fields(log: DataFrame, keys: bool, moments: bool) -> DataFrame:
    """A row per top-level field of each value, and one for a value without fields; the value's first row says what
    holds for the value as a whole.

    The child elements of an XML value are laid out as an object of empty texts, so both formats take one way.
    """
    value = F.col("value")
    rows = log.select("topic", "partition", "offset", "timestamp", "value").withColumn("own", value_format("value"))
    rows = rows.withColumn("outline", xml_outline("value"))
    is_xml = F.coalesce(F.col("own") == "XML", F.lit(False))
    children = F.transform("outline.names", lambda n: F.concat(F.lit('"'), n, F.lit('":""')))
    laid_out = F.concat(F.lit("{"), F.array_join(children, ","), F.lit("}"))
    rows = rows.withColumn("names", F.when(is_xml, F.col("outline.names")).when(F.col("own") == "JSON", F.json_object_keys(value)))
    rows = rows.withColumn("doc", F.try_parse_json(F.when(is_xml, laid_out).otherwise(value)))
    parsed = rows.select(
        "topic", "own", _spot().alias("at"), *([F.unix_millis("timestamp").alias("at_ms")] if moments else []),
        (value.isNotNull() & (is_xml | F.col("doc").isNull())).alias("json_bad"),
        (value.isNotNull() & ~F.coalesce(F.col("outline.ok"), F.lit(False))).alias("xml_bad"),
        F.exists("names", lambda n: F.lower(n).isin(*KEY_NAMES)).alias("named"),
        F.when(F.col("names").isNotNull(), F.col("doc")).alias("doc"), "names", "value",
    )
    fields = parsed.lateralJoin(
        rows.sparkSession.tvf.variant_explode_outer(F.col("doc").outer()).select(
            "pos", F.col("key").alias("column"), F.schema_of_variant("value").alias("kind")
        )
    )
    place = (F.array_position("names", F.col("column")) - 1).cast("int").alias("place")
    first = (F.coalesce("pos", F.lit(0)) == 0).alias("first")
    fields = fields.select("*", place, first)
    beginning = ~F.col("named") & (F.col("place") == 0)
    is_key = F.col("column").isNotNull() & ~is_xml & (F.lower("column").isin(*KEY_NAMES) | beginning)
    fields = fields.withColumn("candidate", is_key if keys else F.lit(False))
    key_text = F.when(F.col("candidate"), json_field(value, F.col("column"), KEY_NAMES))
    return fields.withColumn("key_text", key_text).withColumn("types", _bit(F.col("kind")))


def scan_values(log: DataFrame, keys: bool = True, moments: bool = False) -> DataFrame:
    """Partial results per (topic, format, column, key text), from one scan of the values; checkpointed.

    ``messages`` and the failures to parse count a value once, in one of its rows.  Counts are summed, places of first
    appearance minimised and types united when partial results are merged, so those of several files or batches can
    be put together.  ``keys`` tallies the texts of possible key columns: those of a key's name, and the first column
    of a value that has none.  ``moments`` keeps them apart by millisecond.

    Everything is combined before the shuffle; what is stored has a row per topic, column and different key text.
    """
    by = ["topic", "own", "column", "candidate", "key_text", *(["at_ms"] if moments else [])]
    fields = _fields(log, keys, moments)
    if moments:  # a moment matters to a key only
        fields = fields.withColumn("at_ms", F.when(F.col("candidate"), F.col("at_ms")))
    return checkpointed(fields.groupBy(*by).agg(
        F.count_if("first").alias("messages"),
        F.count_if(F.col("first") & F.col("json_bad")).alias("json_bad"),
        F.count_if(F.col("first") & F.col("xml_bad")).alias("xml_bad"),
        F.min(F.when(F.col("first"), F.col("at"))).alias("voted_at"),
        F.count("*").alias("n"),
        F.min(F.when(F.col("column").isNotNull(), _spot_in("place"))).alias("seen_at"),
        F.bit_or("types").alias("types"),
    ))


def topic_facts(partial: DataFrame) -> DataFrame:
    """Per topic: messages, its format (that of its first value that has one, else ``AUTO``) and malformed values."""
    voted = F.min(F.when(F.col("own") == "JSON", F.col("voted_at"))), F.min(F.when(F.col("own") == "XML", F.col("voted_at")))
    facts = partial.groupBy("topic").agg(
        F.sum("messages").alias("message_count"), F.sum("json_bad").alias("json_bad"), F.sum("xml_bad").alias("xml_bad"),
        voted[0].alias("json_at"), voted[1].alias("xml_at"),
    )
    is_json = F.col("json_at").isNotNull() & (F.col("xml_at").isNull() | (F.col("json_at") < F.col("xml_at")))
    kind = F.when(is_json, "JSON").when(F.col("xml_at").isNotNull(), "XML").otherwise("AUTO")
    bad = F.when(F.col("format") == "JSON", F.col("json_bad")).when(F.col("format") == "XML", F.col("xml_bad"))
    return facts.withColumn("format", kind).select(
        "topic", "message_count", "format", F.coalesce(bad, F.lit(0)).cast("long").alias("poison_count")
    )


def merged_columns(partial: DataFrame, formats: DataFrame) -> DataFrame:
    """(topic, ordinal, column, type): columns of the topic's format in order of first appearance, types widened."""
    found = partial.filter("column IS NOT NULL").groupBy("topic", "own", "column").agg(
        F.min("seen_at").alias("seen_at"), F.bit_or("types").alias("types")
    )
    found = found.join(formats.select("topic", F.col("format").alias("own")), ["topic", "own"])

    def seen(kind: str) -> Column:
        return F.col("types").bitwiseAND(_TYPES[kind]) != 0

    kind = F.when(seen("STRING"), "STRING").when(seen("DOUBLE"), "DOUBLE").when(seen("BIGINT"), "BIGINT").otherwise("BOOLEAN")
    place = F.row_number().over(Window.partitionBy("topic").orderBy("seen_at")) - 1
    return found.select("topic", place.alias("ordinal"), "column", kind.alias("type"))


def candidate_tallies(partial: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tallies (topic, key_text, messages[, at_ms]) of each topic's key column, and the topics for which they are
    not whole: a first column that some value has elsewhere, or beside a key's name."""
    key = keys.filter("key_field IS NOT NULL").select("topic", "key_field", "key_type")
    rows = partial.filter("own = 'JSON' AND column IS NOT NULL")
    # A topic's key column has nearly all rows of the topic: they stay where they are.
    rows = join_by_topic(rows, key, stored=True, spread=F.col("key_text")).filter("column = key_field").drop("key_field")
    partly = rows.groupBy("topic").agg(F.bool_and("candidate").alias("whole")).filter("NOT whole").select("topic")
    moment = [c for c in ("at_ms",) if c in partial.columns]
    told = rows.filter("key_text IS NOT NULL").select("topic", "key_type", "key_text", *moment, F.col("n").alias("messages"))
    return told, partly
