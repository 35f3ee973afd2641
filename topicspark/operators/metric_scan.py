"""Plain metrics over one frame as conditional aggregates of a single scan."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicspark.operators.shared import checkpointed

_NAME = r"[A-Za-z_]\w*"
_TEXT = r"'[^'\\]*'"
_VALUE = rf"(?P<kind>COUNT|SUM|MIN|MAX|AVG)\s*\(\s*(?P<of>\*|{_NAME})\s*\)\s+(?:AS\s+)?metric_value"
_LABEL = rf"(?:(?P<column>{_NAME})(?:\s+AS\s+(?P<alias>{_NAME}))?|(?P<text>{_TEXT})\s+AS\s+(?P<name>{_NAME}))"
_ITEM = re.compile(rf"\s*(?:{_VALUE}|{_LABEL})\s*(?:,|$)", re.IGNORECASE)
_KEY = re.compile(rf"\s*({_NAME}|{_TEXT})\s*(?:,|$)")
_QUERY = re.compile(
    rf"\s*SELECT\s+(?P<items>.+?)\s+FROM\s+\{{(?P<frame>\w+)\}}(?:\s+WHERE\s+(?P<where>.+?))?"
    rf"(?:\s+GROUP\s+BY\s+(?P<by>(?:{_NAME}|{_TEXT})(?:\s*,\s*(?:{_NAME}|{_TEXT}))*))?\s*",
    re.IGNORECASE | re.DOTALL,
)
# What a condition on single rows does not hold, outside its texts.
_BEYOND = re.compile(
    r"\b(SELECT|GROUP|HAVING|ORDER|SORT|CLUSTER|DISTRIBUTE|LIMIT|OFFSET|UNION|INTERSECT|EXCEPT|MINUS|WINDOW|OVER|LATERAL"
    r"|PIVOT|UNPIVOT|JOIN)\b|[{};\\\"`]|--|/\*|\|>",
    re.IGNORECASE,
)


def _all(pattern: re.Pattern, text: str) -> list[re.Match] | None:
    """Matches that cover the whole text one after the other, or None."""
    found, at = [], 0
    while at < len(text):
        match = pattern.match(text, at)
        if match is None or match.end() == at:
            return None
        found.append(match)
        at = match.end()
    return None if text.rstrip().endswith(",") else found


@dataclass(frozen=True)
class PlainMetric:
    """One aggregate of one column (or of rows) under a condition, by columns: what can share a scan.

    ``labels`` holds (name, column or None, text).  ``by`` names the grouping columns; ``grouped`` is also true where a
    query groups by texts alone, which gives no row without input.
    """

    id: str
    sql: str
    frame: str
    kind: str
    of: str | None
    labels: tuple[tuple[str, str | None, str | None], ...]
    order: tuple[int, ...]
    where: str | None
    by: tuple[str, ...]
    grouped: bool

    def condition(self) -> Column:
        return F.lit(True) if self.where is None else F.coalesce(F.expr(f"({self.where})"), F.lit(False))

    def value(self) -> Column:
        inside = F.when(self.condition(), F.lit(1) if self.of is None else F.col(self.of))
        return getattr(F, self.kind)(inside)

    def label_map(self) -> Column:
        if not self.labels:
            return F.create_map().cast("map<string,string>")
        pairs: list[Column] = []
        for name, column, text in self.labels:
            pairs += [F.lit(name), F.lit(text) if column is None else F.coalesce(F.col(column).cast("string"), F.lit("null"))]
        return F.create_map(*pairs)


def plain_metric(id_: str, sql: str, frames: Mapping[str, DataFrame], result: T.StructType) -> PlainMetric | None:
    """The metric of a text ``SELECT agg(c) AS metric_value, labels FROM {frame} [WHERE ..] [GROUP BY ..]``, else None.

    The aggregate is one of COUNT, SUM, MIN, MAX and AVG over a column of the frame, or COUNT(*); labels are grouping
    columns or texts.  ``result`` is the schema that Spark gives the text.  Whatever is written in another way, or is
    not sure to mean this, is None and runs as it stands.
    """
    found = _QUERY.fullmatch(sql)
    if found is None or found["frame"] not in frames:
        return None
    frame = frames[found["frame"]]
    names: dict[str, str] = {name.lower(): name for name in frame.columns}
    # Names that are plain words and tell one column.
    if len(names) != len(frame.columns) or frame.isStreaming:
        return None
    items = _all(_ITEM, found["items"])
    keys = _all(_KEY, found["by"] or "")
    where = found["where"]
    if items is None or keys is None:
        return None
    if where is not None:
        outside = re.sub(r"'[^']*'", "''", where)
        if where.count("'") % 2 or _BEYOND.search(outside) or "\\" in where or "{" in where:
            return None
        depth = 0
        for mark in re.findall(r"[()]", outside):
            depth += 1 if mark == "(" else -1
            if depth < 0:
                return None
        if depth:
            return None
        where = where.strip()
    by = []
    for key in keys:
        if not key[1].startswith("'"):
            if key[1].lower() not in names:
                return None
            by.append(names[key[1].lower()])
    values, labels, order = [], [], []
    for item in items:
        if item["kind"]:
            of = None if item["of"] == "*" else names.get(item["of"].lower(), "")
            if of == "" or (of is None and item["kind"].upper() != "COUNT"):
                return None
            values.append((item["kind"].lower(), of))
            order.append(-1)
        elif item["text"] is not None:
            order.append(len(labels))
            labels.append((item["name"].lower(), None, item["text"][1:-1]))
        else:
            column = names.get(item["column"].lower())
            if column is None or column not in by:
                return None
            order.append(len(labels))
            labels.append(((item["alias"] or item["column"]).lower(), column, None))
    told = [name for name, _, _ in labels]
    if len(values) != 1 or len(set(told)) != len(told) or "metric_value" in told:
        return None
    fields = [field for field in result.fields if field.name.lower() == "metric_value"]
    if len(fields) != 1 or not isinstance(fields[0].dataType, T.NumericType):
        return None
    kind, of = values[0]
    unique_by = tuple(sorted(set(by)))
    return PlainMetric(id_, sql, found["frame"], kind, of, tuple(labels), tuple(order), where, unique_by, bool(keys))


def scan_metrics(frame: DataFrame, metrics: Sequence[PlainMetric]) -> DataFrame:
    """(id, place, metric_value, labels, n) of all metrics from one scan of their frame.

    Every metric is an aggregate over the rows that meet its condition, so the frame is read once, whatever their
    number.  Metrics with the same grouping need no more than that; each further grouping makes one more copy of a row
    (a grouping set) before the partial aggregation.  ``place`` orders a metric's rows as its own query would be: by
    the result's columns as text.
    """
    groupings = sorted({metric.by for metric in metrics})
    keys = sorted({name for by in groupings for name in by})
    aggregates: list[Column] = []
    for i, metric in enumerate(metrics):
        aggregates += [metric.value().alias(f"_value_{i}"), F.count_if(metric.condition()).alias(f"_n_{i}")]
    columns = [F.col(name) for name in keys]
    if len(groupings) == 1:
        grouped = frame.groupBy(*columns).agg(F.lit(0).cast("long").alias("_set"), *aggregates)
        numbers = {groupings[0]: 0}
    else:
        # A set's number has a bit for each key that is not in it, the first key's bit being the highest.
        numbers = {
            by: sum(1 << (len(keys) - 1 - place) for place, name in enumerate(keys) if name not in by) for by in groupings
        }
        sets = [[F.col(name) for name in by] for by in groupings]
        grouped = frame.groupingSets(sets, *columns).agg(F.grouping_id().cast("long").alias("_set"), *aggregates)
    rows = []
    for i, metric in enumerate(metrics):
        value, n = F.col(f"_value_{i}"), F.col(f"_n_{i}")
        label_texts = [F.lit(text) if column is None else F.col(column).cast("string") for _, column, text in metric.labels]
        place = F.array(*[value.cast("string") if at < 0 else label_texts[at] for at in metric.order])
        row = F.struct(
            F.lit(metric.id).alias("id"), place.alias("place"), value.cast("double").alias("metric_value"),
            metric.label_map().alias("labels"), n.alias("n"),
        )
        here = F.col("_set") == numbers[metric.by]
        rows.append(F.when(here & (n > 0) if metric.grouped else here, row))
    told = grouped.select(F.explode(F.filter(F.array(*rows), lambda row: row.isNotNull())).alias("row"))
    return told.select("row.*")


def numbered(rows: DataFrame) -> DataFrame:
    """(id, seq, metric_value, labels) with each metric's rows counted from 0; stored, so that it is computed once.

    The rows are sorted over all tasks, not metric by metric, so one with very many groups does not fill a task.
    """
    ordered = checkpointed(rows.orderBy("id", "place").withColumn("_at", F.monotonically_increasing_id()))
    first = ordered.groupBy("id").agg(F.min("_at").alias("_first"))
    return ordered.join(first, "id").select("id", (F.col("_at") - F.col("_first")).alias("seq"), "metric_value", "labels")
