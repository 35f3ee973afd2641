"""Format of one message value, told from its first character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_format(col: Column | str) -> Column:
    """``JSON``, ``XML`` or null by the first character above U+0020."""
    text = F.col(col) if isinstance(col, str) else col
    first = F.regexp_extract(text, r"^[\x00-\x20]*([^\x00-\x20])", 1)
    return F.when(first.isin("{", "["), F.lit("JSON")).when(first == "<", F.lit("XML"))
