"""Search of a text in a record: anywhere, or at a JSON or XML path."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from topicspark.functions.formats import value_format
from topicspark.functions.json_values import json_text
from topicspark.functions.xml_values import xml_text

__all__ = ["match_path", "value_format", "value_matches"]


def _regex_valid(pattern: str) -> bool:
    try:
        SparkSession.active().sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()
        return True
    except Exception:
        return False


def value_matches(col: Column | str, expected: str | None, regex: bool = False) -> Column:
    """Whether the text holds ``expected``: as a regular expression found anywhere, or as plain text.

    An invalid expression is searched as plain text.  Null text, or nothing to search for, never matches.
    """
    text = F.col(col) if isinstance(col, str) else col
    if expected is None:
        return F.lit(False)
    hit = text.rlike(expected) if regex and _regex_valid(expected) else text.contains(expected)
    return F.coalesce(hit, F.lit(False))


def match_path(
    value: Column | str, expected: str | None, regex: bool = False, path: str | None = None, key: Column | str = "key"
) -> Column:
    """Whether a record matches.

    With a path, JSON and XML values are tested at that path only.  Other values, and every value when there is no
    path, are searched as a whole together with the record's key.
    """
    text = F.col(value) if isinstance(value, str) else value
    anywhere = value_matches(key, expected, regex) | value_matches(text, expected, regex)
    if path is None or not path.strip():
        return anywhere
    kind = value_format(text)
    found = json_text(F.when(kind == "JSON", text), path)
    return (
        F.when(kind == "JSON", value_matches(found, expected, regex))
        .when(kind == "XML", value_matches(xml_text(text, path), expected, regex))
        .otherwise(anywhere)
    )
