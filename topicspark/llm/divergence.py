"""How far the sources of a language differ in their words: sparse term counts merged pair by pair, in whole numbers."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import stored

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
HELD_TERMS = 400_000  # (group, term) counts that a task holds before it sends them on
SLICE_TERMS = 1 << 15  # terms that a pair task merges at once
TASK_SOURCES = 8  # sources of each side of a pair task
# A-Z in lower case; all that is no letter a-z and below U+0080 parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"
_PRICED = "lang string, a string, b string, value long"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TERM_BYTES).split()


def _count(held: int):
    """Occurrences and documents per (lang, source, term) of what a task reads, sent on as soon as ``held`` are held.

    A row without a term counts the texts of its group, so that groups without terms are known too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_with: dict[tuple, Counter] = defaultdict(Counter)
        repeats: dict[tuple, Counter] = defaultdict(Counter)  # occurrences beyond the first of a text; few terms have any

        def sent() -> Iterator[pa.RecordBatch]:
            while texts_with:
                (lang, source), docs = texts_with.popitem()
                more = repeats.pop((lang, source), {})
                counts = [0 if t is None else n + more.get(t, 0) for t, n in docs.items()]
                columns = [
                    pa.array([lang] * len(docs), pa.string()), pa.array([source] * len(docs), pa.string()),
                    pa.array([None if t is None else t.decode("utf-8", "replace") for t in docs], pa.string()),
                    pa.array(counts, pa.int64()), pa.array(docs.values(), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        holds = 0
        for rows in batches:
            for lang, source, text in zip(*(rows.column(i) for i in range(3)), strict=True):
                group = lang.as_py(), source.as_py()
                docs, terms = texts_with[group], Counter(terms_of(text.as_py()))
                holds -= len(docs)
                docs.update(terms.keys())
                docs[None] += 1
                holds += len(docs)
                more = {t: n - 1 for t, n in terms.items() if n > 1}
                if more:
                    repeats[group].update(more)
                if holds >= held:
                    yield from sent()
                    holds = 0
        yield from sent()

    return run


def _price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)); decimals, so that no product overflows."""
    wide = (count + 2).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same on arrays: a long division by thousands, exact for totals below 2**53."""
    over = total + 2 * terms
    whole, rest = np.divmod(counts.astype(np.int64) + 2, over)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, over)
        whole = whole * 1000 + digit
    return whole + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    away = p - q
    return away * away // (p + q)


class Group:
    """One source's slice of terms: sorted ids, their prices, and the price of a term that it lacks."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, total: int, terms: int):
        order = np.argsort(ids)
        self.ids, self.prices = ids[order], prices(counts[order], total, terms)
        self.absent = prices(np.zeros(1, np.int64), total, terms)


def common(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shared ids in two sorted arrays.

    The shorter one gallops through the longer: each id is sought by halving what lies beyond the place of the last, all
    of them at once.
    """
    if len(few) > len(many):
        b, a = common(many, few)
        return a, b
    at = np.searchsorted(many, few)
    inside = np.flatnonzero(at < len(many))
    inside = inside[many[at[inside]] == few[inside]]
    return inside, at[inside]


def divergence(a: Group, b: Group, terms: int) -> int:
    """The sum of gaps over ``terms`` terms, of which each group holds some: in both, in one only, in neither."""
    in_a, in_b = common(a.ids, b.ids)
    only_a, only_b = gaps(a.prices, b.absent), gaps(a.absent, b.prices)
    both = gaps(a.prices[in_a], b.prices[in_b])
    neither = terms - len(a.ids) - len(b.ids) + len(in_a)
    one = int(only_a.sum()) - int(only_a[in_a].sum()) + int(only_b.sum()) - int(only_b[in_b].sum())
    return one + int(both.sum()) + neither * int(gaps(a.absent, b.absent)[0])


def _pair_task(keys: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The unordered pairs between two blocks of sources (or within one) over one slice of terms."""
    lang, low, high = (k.as_py() for k in keys[:3])
    low_side, high_side = [], []
    for row in zip(*(rows.column(c) for c in ("source", "block", "total", "vocabulary", "terms", "cells")), strict=True):
        source, block, total, vocabulary, terms = (x.as_py() for x in row[:5])
        cells = row[5].values
        ids, counts = ([], []) if cells is None else (cells.field(0), cells.field(1))
        group = Group(np.asarray(ids, np.int64), np.asarray(counts, np.int64), total, vocabulary) if terms else None
        (low_side if block == low else high_side).append((source, group, terms))
    out = []
    if low == high:
        low_side.sort(key=lambda x: x[0])  # rows come in any order, and each slice must name a pair alike
        pairs = ((x, y) for i, x in enumerate(low_side) for y in low_side[i + 1 :])
    else:
        pairs = ((x, y) for x in low_side for y in high_side)
    for (a, left, terms), (b, right, _) in pairs:
        out.append((lang, a, b, divergence(left, right, terms) if terms else 0))
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["lang", "a", "b", "value"])


def term_counts(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and texts of each term in each group; a null term stands for the
    group itself.  Null columns count as empty."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = texts.withColumn("text", F.col("text").cast("binary")).mapInArrow(_count(held), _COUNTED)
    # The tasks have summed already: a second table of sums beside theirs would take memory and find little to add up.
    counted = counted.repartition("lang", "source", "term")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _repeated(docs: DataFrame, document: str, held: int) -> DataFrame | None:
    """(lang, term, n = 0, docs): minus the rows beyond the first of each document that holds the term, or None.

    Only rows whose document has several rows in a language are read again; a row without a document counts for none.
    """
    lang, named = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col(document).cast("string").alias("_document")
    again = docs.groupBy(lang, named).agg(F.count("*").alias("_rows")).filter("_rows > 1 OR _document IS NULL")
    again = stored(again.select("lang", "_document"), "term-documents")
    if again.limit(1).count() == 0:
        return None
    rows = docs.select(lang, named, "text")
    known = rows.join(again.filter("_document IS NOT NULL"), ["lang", "_document"], "left_semi")
    rows = known.unionByName(rows.filter("_document IS NULL"))
    # The document takes the source's place; nothing but a missing one is empty.
    counts = term_counts(rows.withColumn("source", F.concat(F.lit("="), "_document")), held).filter("term IS NOT NULL")
    beyond = F.col("docs") - F.when(F.col("source") == "", 0).otherwise(1)
    minus = counts.select("lang", "term", beyond.alias("docs")).groupBy("lang", "term").agg((-F.sum("docs")).alias("docs"))
    return minus.select("lang", "term", F.lit(0).cast("long").alias("n"), "docs")


def source_divergence(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, slice_terms: int = SLICE_TERMS,
    task_sources: int = TASK_SOURCES, held: int = HELD_TERMS, document: str | None = None,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` over the columns lang, source and text.

    Part ``pair``: how far the source is from each other source of its language; part ``term``: the ``top`` terms that
    it has more often than its language, by how much.  A term is a run of letters A-Z (in lower case) and characters
    from U+0080 on; a language keeps the terms in at least ``least`` of its rows.  A group prices each kept term at
    ``1 + floor(UNIT * (count + 2) / (N + 2 * V))``; two prices are ``floor((p - q)^2 / (p + q))`` apart.

    Counts are gathered per task before they are shuffled, so a source with a third of all rows arrives as one row per
    term and task.  Kept terms are dealt into slices and numbered within them; a pair task gets the arrays of up to two
    times about ``task_sources`` sources over one slice, so its size does not grow with the input, and a source's arrays are
    sent once per block of sources.  Only whole numbers are used; totals may reach 2**53.

    Null lang, source and text count as empty, and the empty group is a group.  A source without kept terms is priced
    like any other.  Each row is a document, repeated rows and rows that share an id too; with ``document``, a column of
    ids, rows of one id are one document to the ``least`` ones that a kept term is in, and a null id is none.  Their
    words count row by row all the same.  Without kept terms all pairs of a language have value 0.  Ties of a rank go
    by the item's bytes.  An empty table gives an empty result.
    """
    counts = stored(term_counts(docs, held), "term-counts")
    groups = counts.filter("term IS NULL").select("lang", "source")
    occurring = counts.filter("term IS NOT NULL").select("lang", "term", "n", "docs")
    repeated = None if document is None else _repeated(docs, document, held)
    vocabulary = (occurring if repeated is None else occurring.unionByName(repeated)).groupBy("lang", "term")
    vocabulary = vocabulary.agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    vocabulary = stored(vocabulary.drop("docs"), "term-vocabulary")
    slices = max(1, -(-vocabulary.count() // slice_terms))
    sliced = vocabulary.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int"))
    numbered = sliced.withColumn("id", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")))
    kept = counts.filter("n > 0").select("lang", "source", "term", "n").join(numbered, ["lang", "term"])
    kept = stored(kept, "term-kept")

    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0)
    facts = stored(facts, "term-groups")

    terms = kept.join(facts, ["lang", "source"])
    p, q = _price(F.col("n"), F.col("total"), F.col("vocabulary")), _price(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    terms = terms.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", _gap(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    most = facts.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-most // task_sources)
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    sizes = numbered.groupBy("lang", "slice").agg(F.count("*").alias("terms"))
    every = facts.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("block", block)
    cells = kept.groupBy("lang", "source", "slice").agg(F.collect_list(F.struct("id", "n")).alias("cells"))
    every = every.join(sizes, ["lang", "slice"], "left").join(cells, ["lang", "source", "slice"], "left")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    every = every.fillna(0, ["terms"]).select("*", others).select(
        "lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "slice", "source",
        "block", "total", "vocabulary", "terms", "cells",
    )
    priced = every.groupBy("lang", "low", "high", "slice").applyInArrow(_pair_task, _PRICED)
    pairs = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", both.alias("pair"))
    pairs = pairs.select("lang", "pair.source", F.lit("pair").alias("part"), "pair.item", "value").withColumn("rank", F.row_number().over(by_value))
    return terms.unionByName(pairs).select("lang", "source", "part", "item", "value", "rank")
