"""Values inside JSON text, as column expressions."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The deep search travels with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEP = re.compile(
    r"""\.(?P<length>length\(\))|\.\.(?P<deep>[^.\[\]*?()'"\s]+)|(?P<all>\.\*|\[\*\])|\.(?P<name>[^.\[\]*?()'"]+)"""
    r"""|\['(?P<quoted>[^']+)'\]|\[(?P<index>-?\d+(?:\s*,\s*-?\d+)*)\]|\[(?P<slice>-?\d*:-?\d*)\]"""
)


def json_value(col: Column | str, path: str) -> Column:
    """Scalar at ``path`` as text; null when missing, malformed, or an object or array."""
    text = F.col(col) if isinstance(col, str) else col
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    return F.when(~kind.rlike("^(OBJECT|ARRAY)"), F.get_json_object(text, path))


def json_field(text: Column, field: Column, common: Sequence[str] = ()) -> Column:
    """Top-level field whose name is itself a column.

    The object is read as a map, so any name will do; plain names in ``common`` get a path of their own instead.
    """
    value = F.from_json(text, "map<string,string>")[field]
    for name in common:
        if "'" in name or "\\" in name:
            continue
        value = F.when(field == name, F.get_json_object(text, f"$['{name}']")).otherwise(value)
    return value


def _steps(path: str) -> list[tuple] | None:
    """A path's steps, or None where a step is of no known kind (a filter, say)."""
    steps, at = [], 1
    while at < len(path):
        step = _STEP.match(path, at)
        if step is None:
            return None
        kind = step.lastgroup
        steps.append(("name", step["quoted"]) if kind == "quoted" else (kind, step[kind]))
        at = step.end()
    return steps


def _values(node, deep: bool):
    """The node, and with ``deep`` all below it, in document order."""
    pending = [node]
    while pending:
        node = pending.pop()
        yield node
        if deep and isinstance(node, (dict, list)):
            pending.extend(reversed(list(node.values()) if isinstance(node, dict) else node))


def _picked(node, kind: str, what: str) -> list:
    if kind in ("name", "deep"):
        return [n[what] for n in _values(node, kind == "deep") if isinstance(n, dict) and what in n]
    if kind == "all":
        return list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
    if kind == "length":
        return [len(node)] if isinstance(node, (dict, list)) else []
    if not isinstance(node, list):
        return []
    if kind == "slice":
        return node[slice(*[int(part) if part else None for part in what.split(":")])]
    places = [int(part) for part in what.split(",")]
    return [node[i] for i in places if -len(node) <= i < len(node)]


def _follow(text: str | None, steps: list[tuple]) -> str | None:
    """Text of the value at the steps; an array of the values where a step may pick several."""
    if text is None:
        return None
    try:
        nodes = [json.loads(text)]
    except (ValueError, RecursionError):
        return None
    several = False
    for kind, what in steps:
        nodes = [found for node in nodes for found in _picked(node, kind, what)]
        several |= kind in ("deep", "all", "slice") or (kind == "index" and "," in what)
    if several:
        return json.dumps(nodes, ensure_ascii=False, separators=(",", ":"))
    if not nodes or nodes[0] is None:
        return None
    return nodes[0] if isinstance(nodes[0], str) else json.dumps(nodes[0], ensure_ascii=False, separators=(",", ":"))


def json_text(col: Column | str, path: str) -> Column:
    """Text at ``path``, nested values as JSON; null when missing or malformed.

    Names and places from the start are followed in the JVM, and so is ``[*]`` over arrays.  ``$..name``, ``.*``,
    ``[-1]``, ``[0:2]``, ``[0,1]`` and ``.length()`` are followed in Python;
    those that may pick several values give the array of them.  Filters and any other step are refused.
    """
    text = F.col(col) if isinstance(col, str) else col
    path = path.strip()
    if not path.startswith("$"):  # a path of another kind finds nothing in JSON
        return F.get_json_object(text, path)
    steps = _steps(path)
    if steps is None:
        raise ValueError(f"unsupported JSON path: {path!r}")
    if all(kind == "name" or (kind == "index" and what.isdigit()) or what == "[*]" for kind, what in steps):
        return F.get_json_object(text, path)

    @F.pandas_udf(T.StringType())
    def follow(values: pd.Series) -> pd.Series:
        return values.map(lambda value: _follow(value, steps)).astype("object")

    # Text that lacks a name of the path cannot hold the value, and need not travel; an escaped name may hide.
    may = F.lit(True)
    for kind, what in steps:
        if kind in ("name", "deep") and what.isascii() and what.isidentifier():
            may &= text.contains(f'"{what}"') | text.contains("\\u")
    return F.when(may, follow(F.when(may, text)))
