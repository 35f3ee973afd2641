"""Comparison of two topics, or of one query over two topics, by an ID column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicspark.operators.shared import BROADCAST_ROWS, checkpointed

# Types whose hash tells apart what grouping tells apart, once nulls are marked.
_FLAT = (
    T.BooleanType, T.IntegralType, T.FractionalType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


# Bytes of a digest.
_DIGEST = 16


def _is_flat(kind: T.DataType) -> bool:
    return isinstance(kind, _FLAT) or kind == T.StringType()


def _width(kind: T.DataType) -> int:
    """Bytes that a value takes at most, beyond a digest's where it has no bound."""
    return _DIGEST if isinstance(kind, T.DecimalType) else _DIGEST + 1 if isinstance(kind, T.StringType | T.BinaryType) else 8


def _shared(a: DataFrame, b: DataFrame, id_col: str, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols is not None else [name for name in a.columns if name in b.columns and name != id_col]


def _tagged(a: DataFrame, b: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return (
        a.select(*columns, one.alias("in_a"), none.alias("in_b"))
        .union(b.select(*columns, none.alias("in_a"), one.alias("in_b")))
    )


def _digest(frame: DataFrame, columns: Sequence[str]) -> list[Column]:
    """128 bits that stand for the columns' values, nulls included, or the values where a column is nested or all of
    them together are no longer."""
    kinds = [frame.schema[name].dataType for name in columns]
    if not all(map(_is_flat, kinds)) or sum(map(_width, kinds)) <= _DIGEST:
        return [F.struct(*[F.col(f"`{name}`") for name in columns]).alias("content")]
    marked: list[Column] = []
    for name in columns:
        marked += [F.col(f"`{name}`").isNull(), F.col(f"`{name}`")]
    return [F.xxhash64(F.lit(seed), *marked).alias(f"digest_{seed}") for seed in (1, 2)]


def _widened(a: DataFrame, b: DataFrame, id_col: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the types that a union of them has: equal values must hash alike."""
    picked = [F.col(f"`{name}`") for name in dict.fromkeys([id_col, *columns])]
    types = {field.name: field.dataType for field in a.select(*picked).union(b.select(*picked)).schema}
    wide = {name: F.col(f"`{name}`").cast(kind) for name, kind in types.items()}
    return a.withColumns(wide), b.withColumns(wide)


def _only_differing(a: DataFrame, b: DataFrame, id_col: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides without the IDs whose messages are the same on either by their digests.

    IDs and digests alone are shuffled.  The IDs left are stored, and broadcast where there are at most
    ``BROADCAST_ROWS``; the sides are then read again for those.
    """
    wide_a, wide_b = _widened(a, b, id_col, columns)
    digest = _digest(wide_a, columns)
    names = wide_a.select(*digest).columns
    if names == ["content"]:
        return a, b
    per_digest = (
        _tagged(wide_a, wide_b, [F.col(f"`{id_col}`").alias("id"), *digest])
        .groupBy("id", *names)
        .agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))
    )
    wanted = checkpointed(per_digest.filter("in_a <> in_b").select(F.col("id").alias("_differs")).distinct())
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = F.broadcast(wanted) if small else wanted
    differs = F.col(f"`{id_col}`").cast(wanted.schema[0].dataType).eqNullSafe(F.col("_differs"))
    return a.join(kept, differs, "left_semi"), b.join(kept, differs, "left_semi")


def compare_topics(
    a: DataFrame, b: DataFrame, id_col: str, cols: Sequence[str] | None = None, diff_only: bool = False
) -> DataFrame:
    """Messages of two sides by ID: ``equal``, ``modified``, ``only_a`` or ``only_b``, with both values of each column.

    Equal messages are counted off against each other first, whatever their number.  Of the rest, one message on each
    side makes a ``modified`` row.  Where an ID repeats with several contents, no pairing is defined: each stands in a
    row of its own with one side null, ``modified`` if the other side has a rest too.  ``messages_a`` and
    ``messages_b`` add up to the sizes of the two sides.  No pairs are formed, and null is an ID like any other.  A
    compared column called ``id``, ``status``, ``messages_a`` or ``messages_b`` comes as ``id_value`` and so on.

    With ``diff_only`` IDs are first compared by 128-bit digests of their messages, and contents are read, shuffled
    and compared for the IDs that differ alone.  Nested columns, and contents no longer than a digest, are compared
    as they are from the start.
    """
    columns = _shared(a, b, id_col, cols)
    if diff_only and columns:
        a, b = _only_differing(a, b, id_col, columns)
    # Apart from the columns' own names from here on.
    content = F.struct(*[F.col(f"`{name}`") for name in columns]) if columns else F.struct(F.lit(None).alias("_"))
    sides = _tagged(a, b, [F.col(f"`{id_col}`").alias("id"), content.alias("content")])
    contents = sides.groupBy("id", "content").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))
    tallied = contents.withColumn("common", F.least("in_a", "in_b"))
    nothing = F.lit(None).cast(tallied.schema["content"].dataType)

    equal = tallied.filter("common > 0").select(
        "id", F.lit("equal").alias("status"), F.col("common").alias("messages_a"),
        F.col("common").alias("messages_b"), F.col("content").alias("a"), F.col("content").alias("b"),
    )
    rest = tallied.filter("in_a <> in_b").select(
        "id", "content", (F.col("in_a") - F.col("common")).alias("in_a"), (F.col("in_b") - F.col("common")).alias("in_b")
    )
    left_a, left_b = F.col("in_a") > 0, F.col("in_b") > 0
    per_id = rest.groupBy("id").agg(
        F.count_if(left_a).alias("contents_a"),
        F.count_if(left_b).alias("contents_b"),
        F.sum("in_a").alias("messages_a"),
        F.sum("in_b").alias("messages_b"),
        F.max(F.when(left_a, F.col("content"))).alias("a"),
        F.max(F.when(left_b, F.col("content"))).alias("b"),
    )
    status = (
        F.when(F.col("contents_b") == 0, "only_a").when(F.col("contents_a") == 0, "only_b").otherwise("modified")
    )
    per_id = per_id.withColumn("status", status)
    single = (F.col("contents_a") <= 1) & (F.col("contents_b") <= 1)
    plain = per_id.filter(single).select("id", "status", "messages_a", "messages_b", "a", "b")
    repeated = per_id.filter(~single).select(F.col("id").alias("_id"), "status")
    listed = rest.join(repeated, F.col("id").eqNullSafe(F.col("_id"))).select(
        "id", "status", F.col("in_a").alias("messages_a"), F.col("in_b").alias("messages_b"),
        F.when(left_a, F.col("content")).otherwise(nothing).alias("a"),
        F.when(left_b, F.col("content")).otherwise(nothing).alias("b"),
    )
    rows = plain.unionByName(listed)
    if not diff_only:
        rows = rows.unionByName(equal)

    def both(name: str):
        left, right = F.col("a").getField(name), F.col("b").getField(name)
        same = F.col("a").isNotNull() & F.col("b").isNotNull() & left.eqNullSafe(right)
        alias = name if name.lower() not in ("id", "status", "messages_a", "messages_b") else f"{name}_value"
        return F.struct(left.alias("a"), right.alias("b"), same.alias("same")).alias(alias)

    return rows.select("id", "status", "messages_a", "messages_b", *[both(name) for name in columns])


def missing_records(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """IDs found on one side only, with that side and the number of its messages."""
    per_id = _tagged(a, b, [F.col(f"`{id_col}`").alias("id")]).groupBy("id").agg(
        F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b")
    )
    return per_id.filter("in_a = 0 OR in_b = 0").select(
        "id", F.when(F.col("in_b") == 0, "a").otherwise("b").alias("side"), (F.col("in_a") + F.col("in_b")).alias("messages")
    )


def schema_mismatch(schema_a: DataFrame, schema_b: DataFrame) -> DataFrame:
    """Columns that one side lacks or has with another type; the inputs are inferred schemas of one topic each."""
    left = schema_a.select("column", F.col("type").alias("type_a"))
    right = schema_b.select("column", F.col("type").alias("type_b"))
    both = left.join(right, "column", "full_outer")
    return both.filter(~F.col("type_a").eqNullSafe(F.col("type_b")))


def throughput(log: DataFrame) -> DataFrame:
    """Messages of each topic and their rate per second from first to last; no rate where these coincide."""
    span = F.unix_millis(F.max("timestamp")) - F.unix_millis(F.min("timestamp"))
    per_topic = log.groupBy("topic").agg(F.count("*").alias("messages"), span.alias("span_ms"))
    rate = F.try_divide(F.col("messages").cast("double") * 1000.0, F.col("span_ms").cast("double"))
    return per_topic.select("topic", "messages", rate.alias("msg_per_s"))


def compare_summary(
    a: DataFrame, b: DataFrame, id_col: str, cols: Sequence[str] | None = None, time_col: str | None = None
) -> DataFrame:
    """One row: differing messages by kind, columns that differ, and count and rate of each side.

    ``time_col`` is the event time on both sides; without it there are no rates.  Either side is read once, and IDs,
    128-bit digests and times are all that is shuffled (contents where a compared column is nested or all are short).
    """
    columns = _shared(a, b, id_col, cols)
    wide_a, wide_b = _widened(a, b, id_col, columns)
    digest = _digest(wide_a, columns) if columns else [F.lit(0).alias("digest")]
    names = wide_a.select(*digest).columns
    at = F.lit(None).cast("bigint") if time_col is None else F.unix_millis(F.col(f"`{time_col}`"))
    sides = _tagged(wide_a, wide_b, [F.col(f"`{id_col}`").alias("id"), *digest, at.alias("at")])
    spans = ["first_a", "last_a", "first_b", "last_b"]
    at_a, at_b = F.when(F.col("in_a") > 0, F.col("at")), F.when(F.col("in_b") > 0, F.col("at"))
    ends = [F.min(at_a), F.max(at_a), F.min(at_b), F.max(at_b)]
    per_digest = sides.groupBy("id", *names).agg(
        F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"), *[end.alias(name) for end, name in zip(ends, spans)]
    )
    merged = [F.min("first_a"), F.max("last_a"), F.min("first_b"), F.max("last_b")]
    merged = [end.alias(name) for end, name in zip(merged, spans)]
    per_id = per_digest.groupBy("id").agg(
        F.count_if(F.col("in_a") > F.col("in_b")).alias("rest_a"),
        F.count_if(F.col("in_b") > F.col("in_a")).alias("rest_b"),
        F.sum("in_a").alias("in_a"),
        F.sum("in_b").alias("in_b"),
        *merged,
    )
    # One row for an ID with one remaining content per side at most, else one for each: as compare_topics lists them.
    rest = F.col("rest_a") + F.col("rest_b")
    both = (F.col("rest_a") > 0) & (F.col("rest_b") > 0)
    per_id = per_id.withColumn("rows", F.when((F.col("rest_a") <= 1) & (F.col("rest_b") <= 1), F.least(rest, F.lit(1))).otherwise(rest))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0)).cast("bigint")

    whole = per_id.agg(
        total(F.lit(True)).alias("differences"),
        total(both).alias("modified"),
        total((F.col("rest_a") > 0) & ~both).alias("only_a"),
        total((F.col("rest_b") > 0) & ~both).alias("only_b"),
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("messages_a"),
        F.coalesce(F.sum("in_b"), F.lit(0)).alias("messages_b"),
        *merged,
    )

    def rate(name: str) -> Column:
        span = (F.col(f"last_{name}") - F.col(f"first_{name}")).cast("double")
        return F.try_divide(F.col(f"messages_{name}").cast("double") * 1000.0, span).alias(f"msg_per_s_{name}")

    types_a, types_b = dict(a.dtypes), dict(b.dtypes)
    differing = [name for name in sorted({*types_a, *types_b}) if types_a.get(name) != types_b.get(name)]
    return whole.select(
        "differences", "modified", "only_a", "only_b", "messages_a", rate("a"), "messages_b", rate("b"),
        F.lit(len(differing)).cast("bigint").alias("schema_mismatches"),
    )
