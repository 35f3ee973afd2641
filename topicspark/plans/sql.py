"""SQL over topics."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from topicspark.functions.xml_values import xml_extract_sql


# Values of JSON and XML text under the names that query texts use.  Arguments are expanded in place.
_JSON_VALUE = """CREATE OR REPLACE TEMPORARY FUNCTION JSON_VALUE(text STRING, path STRING) RETURNS STRING
RETURN CASE WHEN NOT regexp(schema_of_variant(try_variant_get(try_parse_json(text), path, 'variant')), '^(OBJECT|ARRAY)')
  THEN get_json_object(text, path) END"""


def register_functions(spark: SparkSession) -> None:
    """Make ``JSON_VALUE(text, path)`` and ``XmlExtract(text, path)`` callable in the session's SQL."""
    spark.sql(_JSON_VALUE)
    spark.udf.register("XmlExtract", xml_extract_sql)


# Window functions over a table as streaming SQL writes them: TABLE(TUMBLE(TABLE t, DESCRIPTOR(c), INTERVAL '1' HOUR)).
_WINDOWS = re.compile(
    r"""TABLE\s*\(\s*(TUMBLE|HOP)\s*\(\s*(?:DATA\s*=>\s*)?TABLE\s+([\w.`{}]+)\s*,\s*(?:TIMECOL\s*=>\s*)?
    DESCRIPTOR\s*\(\s*([\w.`]+)\s*\)\s*,\s*(?:\w+\s*=>\s*)?(INTERVAL\s+'[^']+'\s+\w+)
    (?:\s*,\s*(?:\w+\s*=>\s*)?(INTERVAL\s+'[^']+'\s+\w+))?\s*\)\s*\)""",
    re.IGNORECASE | re.VERBOSE,
)


def with_windows(sql: str) -> str:
    """The text with table-valued TUMBLE and HOP as Spark's ``window``: the table's rows with ``window_start`` and
    ``window_end``; one row per window for HOP, whose intervals are the slide and the size.  Texts without them stay
    as they are."""

    def written(found: re.Match) -> str:
        kind, table, column, first, second = found.groups()
        if (kind.upper() == "HOP") != (second is not None):
            raise ValueError(f"TUMBLE takes one interval and HOP two: {found[0]!r}")
        lengths = [re.sub(r"(?i)^INTERVAL\s+'([^']+)'\s+(\w+)$", r"\1 \2", x) for x in (second, first) if x]
        if kind.upper() == "TUMBLE":
            lengths = lengths[:1]
        spans = ", ".join(f"'{x}'" for x in lengths)
        return (
            f"(SELECT * EXCEPT (_window), _window.start AS window_start, _window.end AS window_end"
            f" FROM (SELECT *, window({column}, {spans}) AS _window FROM {table}))"
        )

    return _WINDOWS.sub(written, sql)


def _only_query(spark: SparkSession, sql: str) -> None:
    jvm = spark._jvm
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    for kind in ("Command", "ParsedStatement"):
        if jvm.java.lang.Class.forName(logical + kind, True, jvm.Thread.currentThread().getContextClassLoader()).isInstance(plan):
            raise ValueError(f"not a query: {sql[:80]!r}")


def run_sql(
    spark: SparkSession,
    sql: str,
    max_rows: int | None = None,
    args: Mapping[str, Any] | None = None,
    **frames: DataFrame,
) -> DataFrame:
    """Result of a query over ``{name}`` frames and temp views; ``max_rows`` limits it where given.

    The read mode is the frames' own: see ``read_topic``.  ``args`` fills ``:name`` markers.  Commands and INSERT are
    refused before anything runs: Spark's parser tells what the text is.  ``JSON_VALUE`` and ``XmlExtract`` can be called,
    and ``TABLE(TUMBLE(TABLE t, DESCRIPTOR(c), INTERVAL '1' HOUR))`` and ``HOP`` are read as in ``with_windows``.
    """
    sql = with_windows(sql)
    if not spark.catalog.functionExists("JSON_VALUE") or not spark.catalog.functionExists("XmlExtract"):
        register_functions(spark)
    _only_query(spark, re.sub(r"\{\w+\}", "frame", sql))
    result = spark.sql(sql, args=dict(args) if args else None, **frames)
    return result if max_rows is None else result.limit(max_rows)


def run_template(
    spark: SparkSession, sql: str, topic: DataFrame, args: Mapping[str, Any] | None = None, max_rows: int | None = None
) -> DataFrame:
    """The same query text over any topic: its ``{topic}`` placeholder is the frame."""
    return run_sql(spark, sql, max_rows, args, topic=topic)
