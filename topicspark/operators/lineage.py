"""Lineage tables read from the texts of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOPIC_PATTERN = r"'topic'\s*=\s*'([^']+)'"
# Comments and texts, then functions that have a FROM of their own.
_NOT_CODE = r"(?s)--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'"
_INNER_FROM = r"(?i)\b(?:EXTRACT|TRIM|SUBSTRING|OVERLAY)\s*\([^()]*\)"
# A name's parts may stand in backquotes, with anything in them.
_QUOTED = r"`(?:[^`]|``)*`"
_NAME = rf"(?:{_QUOTED}|[^\s,;()`])++(?!\s*\()"
# Words that follow a table, or an expression, and are no alias of it.
_WORDS = (
    "WHERE|JOIN|ON|USING|LEFT|RIGHT|FULL|INNER|CROSS|NATURAL|LATERAL|GROUP|ORDER|SORT|CLUSTER|DISTRIBUTE|HAVING|LIMIT|"
    "OFFSET|WINDOW|UNION|EXCEPT|INTERSECT|MINUS|FROM|SELECT|SET|VALUES|ASC|DESC|NULLS|AND|OR"
)
_NAMED = rf"\s+(?:AS\s+)?(?!(?:{_WORDS})\b)(?:\w+|{_QUOTED})(?:\s*\([^()]*\))?"
_LIST = rf"((?:{_NAME}(?:{_NAMED})?\s*,\s*)*{_NAME})"
# A table, or tables separated by commas, each with an alias or none.
_TABLES = rf"(?i)\b(?:FROM|JOIN)\s+{_LIST}"
# How such a list goes on behind a subquery and its alias.
_GOES_ON = rf"(?i)\){_NAMED}\s*,\s*{_LIST}(?:{_NAMED})?\s*(?=$|[;)]|\b(?:{_WORDS.replace('FROM|SELECT|', '').replace('|ASC|DESC|NULLS|AND|OR', '')})\b)"
_EACH = rf"(?:^|,)\s*({_NAME})"
_CTE = r"(?i)(?:\bWITH(?:\s+RECURSIVE)?|,|\))\s*(\w+)(?:\s*\([^()]*\))?\s+AS\s*\("
_TARGETS = rf"(?i)\bINSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?((?:{_QUOTED}|[^\s(;`])+)"


def _unquoted(name: Column) -> Column:
    return F.regexp_replace(name, "`", "")


def _sources(ddl: Column) -> Column:
    """Distinct tables that a statement reads, without the names it defines itself."""
    code = F.regexp_replace(F.regexp_replace(ddl, _NOT_CODE, "''"), _INNER_FROM, "f()")
    lists = F.concat(*[F.regexp_extract_all(code, F.lit(found), 1) for found in (_TABLES, _GOES_ON)])
    names = F.flatten(F.transform(lists, lambda one: F.regexp_extract_all(one, F.lit(_EACH), 1)))
    names = F.array_distinct(F.transform(names, _unquoted))
    own = F.transform(F.regexp_extract_all(code, F.lit(_CTE), 1), F.lower)
    return F.filter(names, lambda name: ~F.array_contains(own, F.lower(name)) & ~F.lower(name).isin("lateral", "unnest"))


def _targets(ddl: Column) -> Column:
    found = F.regexp_extract_all(F.regexp_replace(ddl, _NOT_CODE, "''"), F.lit(_TARGETS), 1)
    return F.array_distinct(F.transform(found, _unquoted))


def _parts(statements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    jobs = statements.filter(F.col("kind").eqNullSafe("job") & (F.size(_targets(F.col("ddl"))) > 0)).withColumn(
        "node", F.concat(F.lit("query_"), "id")
    )
    tables = statements.filter("kind = 'table'").withColumn("topic", F.regexp_extract("ddl", TOPIC_PATTERN, 1))
    return jobs, tables, statements.filter("kind = 'view'")


def lineage_edges(statements: DataFrame, known_only: bool = False) -> DataFrame:
    """Edges (from, to, label) of statements (id, kind, ddl); kind is ``table``, ``view`` or ``job``.

    ``known_only`` keeps those sources that are a table or view of the input.
    """
    jobs, tables, views = _parts(statements)
    topics = tables.filter("topic <> ''").select(
        F.concat(F.lit("topic_"), "topic").alias("from"), F.col("id").alias("to"), F.lit("source").alias("label")
    )
    depends = views.select(F.explode(_sources(F.col("ddl"))).alias("from"), F.col("id").alias("to"), F.lit("depends").alias("label"))
    reads = jobs.select(F.explode(_sources(F.col("ddl"))).alias("from"), F.col("node").alias("to"), F.lit("reads").alias("label"))
    read = depends.unionByName(reads)
    if known_only:
        known = statements.filter("kind IN ('table', 'view')").select(F.col("id").alias("from"))
        read = read.join(known, "from", "left_semi")
    target = F.explode(_targets(F.col("ddl")))
    writes = jobs.select(F.col("node").alias("from"), target.alias("to"), F.lit("writes").alias("label"))
    return topics.unionByName(read).unionByName(writes)


def lineage_nodes(statements: DataFrame) -> DataFrame:
    """Nodes (id, label, type) of the same statements: topics, tables, views and running queries."""
    jobs, tables, views = _parts(statements)

    def named(rows: DataFrame, id_: Column, label: Column, kind: str) -> DataFrame:
        return rows.select(id_.alias("id"), label.alias("label"), F.lit(kind).alias("type"))

    own = F.col("id")
    topics = tables.filter("topic <> ''")
    return (
        named(jobs, F.col("node"), F.lit("INSERT"), "query")
        .unionByName(named(tables, own, own, "table"))
        .unionByName(named(topics, F.concat(F.lit("topic_"), "topic"), F.col("topic"), "topic"))
        .unionByName(named(views, own, own, "view"))
        .distinct()
    )
