"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import WORD, join_facts, stored, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
BUCKETS = 4096


def words_in(column: str = "text") -> Column:
    return F.size(F.regexp_extract_all(text_of(column), F.lit(WORD), F.lit(0))).cast("long")


def uniform(id_col: str, seed: str = SEED) -> Column:
    """A number in (0, 1) fixed by the id and the seed: 48 bits of an MD5 digest, moved off both ends."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from rows of (source, size).

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all sizes by them.  A target stops
    at ``most`` times its source's size and the excess goes to the others: with the sources in order of the level at
    which they are full, the running sums tell which are full, and the first that is not gives everyone's level.
    The windows run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    facts = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    facts = facts.withColumn("level", left / rest)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.max(F.when(~full, F.col("level"))).over(whole)
    target = F.when(full, F.col("cap")).otherwise(level * F.col("weight"))
    return facts.select("source", "source_size", target.alias("target"))


def _rank(share: Column) -> Column:
    """Random odds over inclusion odds; null where the share is 0."""
    return F.try_divide(F.col("u") / (1 - F.col("u")), share / (1 - share))


def pareto_mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """``(sizes, places)``: the stored (id, source, size, u) rows, and per source where its sample ends.

    A source is to give ``target`` of its ``source_size``: every document ``floor(target / source_size)`` times whole,
    and a sample that makes up the rest.  A document's inclusion probability is the fraction left; documents are ranked
    by random odds divided by inclusion odds, and enter in that order while the rest is not exceeded.  Where one more
    document brings the sum nearer, the one of the best size is added.

    No window holds a source: ranks are summed by buckets first, and only the bucket in which the sample ends is put in
    order.  Sources number at most a few; documents and words are not limited.

    Null ids rank as one document with the text "null"; rows that repeat an id in a source enter together or not at
    all.  The null source is a source.  Documents without words and an empty table give no words.
    """
    size = words_in() if size is None else size
    sizes = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), uniform(id_col, seed).alias("u")
    )
    sizes = stored(sizes, "mix-sizes")
    facts = stored(source_targets(sizes, weights, share, most), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    facts = facts.withColumn("whole", F.floor(copies)).withColumn("part", copies - F.floor(copies))
    facts = facts.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    ranked = join_facts(sizes, facts.filter("part > 0"), "source", F.col("id"))
    ranked = ranked.groupBy("source", "id", "u", "part", "rest").agg(F.sum("size").alias("size"))
    ranked = stored(ranked.withColumn("rank", _rank(F.col("part"))).select("source", "id", "rank", "rest", "size"), "mix-ranks")
    bucket = F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS)
    sums = ranked.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("bucket")
    edges = sums.withColumn("upto", F.sum("words").over(so_far)).filter(F.col("upto") > F.col("rest"))
    edges = edges.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("sum")), "bucket").alias("edge"))
    edges = stored(edges.select("source", "edge.bucket", F.col("edge.sum").alias("sum")), "mix-edges")

    inside = join_facts(ranked.withColumn("_bucket", bucket), edges, "source", F.col("id")).filter("_bucket = bucket")
    place = F.struct("rank", F.col("id").isNull().alias("no_id"), "id")
    in_order = Window.partitionBy("source").orderBy("rank", F.col("id").isNull(), "id")
    inside = inside.withColumn("upto", F.col("sum") + F.sum("size").over(in_order)).withColumn("place", place)
    first_out = (
        inside.filter(F.col("upto") > F.col("rest")).groupBy("source")
        .agg(F.min_by(F.struct("place", (F.col("upto") - F.col("size")).alias("sum")), "place").alias("out"))
    )
    first_out = stored(first_out.select("source", "out.place", F.col("out.sum").alias("sum")), "mix-ends")

    beyond = join_facts(ranked.withColumn("_place", place), first_out, "source", F.col("id")).filter("_place >= place")
    lacks = F.col("rest") - F.col("sum")
    nearest = F.struct(F.abs(lacks - F.col("size")).alias("off"), F.col("_place").alias("place"))
    added = beyond.filter(F.abs(lacks - F.col("size")) < lacks).groupBy("source").agg(F.min(nearest).alias("added"))
    ends = first_out.withColumnRenamed("source", "_source").join(
        added.withColumnRenamed("source", "_also"), F.col("_source").eqNullSafe(F.col("_also")), "left"
    )
    places = facts.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", "source_size", "target", "whole", "part", F.col("place").alias("out"), F.col("added.place").alias("added")
    )
    return sizes, stored(places, "mix-places")


def _copies(id_col: Column) -> Column:
    """How often a row with ``u`` and the columns of ``places`` enters."""
    place = F.struct(_rank(F.col("part")).alias("rank"), id_col.isNull().alias("no_id"), id_col.alias("id"))
    sampled = F.col("out").isNull() | (place < F.col("out")) | F.coalesce(place == F.col("added"), F.lit(False))
    return (F.col("whole") + F.when((F.col("part") > 0) & sampled, 1).otherwise(0)).cast("long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (``copies`` times its size), copies."""
    sizes, places = pareto_mix(docs, **options)
    rows = join_facts(sizes, places, "source", F.col("id")).withColumn("copies", _copies(F.col("id")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", taken)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, **options) -> DataFrame:
    """The mixture itself: every row of ``docs``, all columns, as often as it enters.  The texts are not shuffled."""
    _, places = pareto_mix(docs, id_col, source_col, seed=seed, **options)
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), uniform(id_col, seed).alias("u"))
    rows = join_facts(held, places, "source", F.col(f"row.{id_col}"))
    rows = rows.withColumn("copies", _copies(F.col(f"row.{id_col}"))).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
