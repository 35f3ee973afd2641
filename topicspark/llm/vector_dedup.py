"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import join_facts, stored
from topicspark.llm.components import components

THRESHOLD = 0.93
WINDOW = 16
MISSED = 0.02
LEAST_COSINE = 0.5  # of centred vectors at the threshold; below it passes are added by what they find
FRESH = 0.01  # share of links that a further round of passes must add to be followed by another
SEED = 7
BLOCK = 1024
_BITS = 63


def passes_for(
    group: int, window: int = WINDOW, threshold: float = THRESHOLD, missed: float = MISSED, common: float = 0.0
) -> int:
    """Passes after which a pair at the threshold has been missed with a probability of at most ``missed``.

    In a group of that many vectors, two vectors stand within a window if they agree in their first log2(group/window)
    bits; each bit agrees with the probability 1 - angle / pi.  Bits are signs of centred vectors: with ``common``, the
    squared length of the mean of the unit vectors, taken out, a cosine at the threshold is smaller.
    """
    bits = max(1, math.ceil(math.log2(max(2, group / window))))
    threshold = max(LEAST_COSINE, (threshold - common) / max(1e-9, 1 - common))
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return max(2, math.ceil(math.log(missed) / math.log(1 - met)))


@lru_cache(maxsize=256)
def _planes(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, number, dim]).standard_normal((dim, _BITS))


def _unit(rows: list) -> np.ndarray:
    vectors = np.array(rows, dtype=np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _keys(numbers: range):
    """Each vector once per pass, with the signs of its centred projections as one number, first projection first."""
    weights = 1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = np.diff(rows.column("v").offsets.to_numpy())
            for dim in np.unique(sizes):
                some = rows.take(pa.array(np.flatnonzero(sizes == dim)))
                unit = _unit(some.column("v").to_pylist()) - np.array(some.column("mean").to_pylist(), np.float64)
                for number in numbers:
                    key = ((unit @ _planes(number, int(dim))) > 0) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), number, np.int32)), some.column("label"),
                         pa.array(np.full(len(key), dim, np.int32)), pa.array(key), some.column("rep"), some.column("v")],
                        ["pass", "label", "dim", "key", "rep", "v"],
                    )

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label and size: the sum and the number of a batch's unit vectors."""
    for rows in batches:
        frame = rows.to_pandas()
        frame["dim"] = frame["v"].map(len).astype("int32")
        out = [(label, dim, _unit(some["v"].tolist()).sum(axis=0), len(some)) for (label, dim), some in frame.groupby(["label", "dim"])]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int64()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["label", "dim", "sum", "n"])


def _means(reps: DataFrame) -> DataFrame:
    """Stored: label, dim, ``n``, the ``mean`` of the unit vectors and its squared length ``common``."""
    sums = reps.select("label", "v").mapInArrow(_sums, "label long, dim int, sum array<double>, n long")

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].sum()
        mean = np.sum(rows["sum"].tolist(), axis=0) / n
        return pd.DataFrame({"label": rows["label"].iloc[:1], "dim": rows["dim"].iloc[:1], "n": [n], "mean": [mean], "common": [mean @ mean]})

    return stored(sums.groupBy("label", "dim").applyInPandas(total, "label long, dim int, n long, mean array<double>, common double"), "vector-means")


def _forest(links: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """For each of n rows the first row it is connected to by the links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for a, b in links:
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _window_links(group: np.ndarray, vectors: np.ndarray, window: int, threshold: float) -> list:
    links = []
    for off in range(1, min(window, len(group) - 1) + 1):
        close = (group[off:] == group[:-off]) & (np.einsum("ij,ij->i", vectors[off:], vectors[:-off]) >= threshold)
        at = np.flatnonzero(close)
        links.append((at, at + off))
    return links


def _compare(window: int, threshold: float):
    """Each row in order against the next ``window`` of its pass, label and size; verified pairs as a forest.

    Also gives the first and the last ``window`` rows of the task, for the windows that cross its ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rest, head = TaskContext.get().partitionId(), None, 0
        names = ["a", "b", "edge", "place", "pass", "label", "dim", "v"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64())]

        def rim(rows: pd.DataFrame, edge: int, places: range) -> pa.RecordBatch:
            columns = [rows["rep"], None, [edge] * len(rows), list(places), rows["pass"], rows["label"], rows["dim"], list(rows["v"])]
            columns[1] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows = batch.to_pandas()
            if head < window and len(rows):
                first = rows.iloc[: window - head]
                yield rim(first, part - 1, range(window + head, window + head + len(first)))
                head += len(first)
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            for dim, some in rows.groupby("dim", sort=False):
                group = some.groupby(["pass", "label"], sort=False).ngroup().to_numpy()
                unit = _unit(some["v"].tolist())
                root = _forest(_window_links(group, unit, window, threshold), len(some))
                reps = some["rep"].to_numpy()
                at = np.flatnonzero(root != np.arange(len(root)))
                empty = [None] * len(at)
                columns = [reps[at], reps[root[at]], *[empty] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
            rest = rows.iloc[-window:]
        if rest is not None:
            yield rim(rest, part, range(len(rest)))

    return run


def _links(centred: DataFrame, numbers: range, window: int, threshold: float) -> DataFrame:
    """Stored: verified pairs (a, b) that connect what the windows of the passes of these numbers found."""
    order = ["pass", "label", "dim", "key", "rep"]
    kind = centred.schema["v"].dataType
    keyed = centred.select("rep", "label", "v", "mean").mapInArrow(
        _keys(numbers), f"pass int, label long, dim int, key long, rep long, v {kind.simpleString()}"
    )
    found = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _compare(window, threshold), "a long, b long, edge long, place int, pass int, label long, dim int, v array<double>"
    )
    found = stored(found, "vector-links")

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("place"), []
        for _, some in rows.groupby("dim", sort=False):
            group = some.groupby(["pass", "label"], sort=False).ngroup().to_numpy()
            root = _forest(_window_links(group, _unit(some["v"].tolist()), window, threshold), len(some))
            a = some["a"].to_numpy()
            at = np.flatnonzero(root != np.arange(len(root)))
            out.append(pd.DataFrame({"a": a[at], "b": a[root[at]]}))
        return pd.concat(out)

    rims = found.filter(F.col("edge").isNotNull()).groupBy("edge").applyInPandas(across, "a long, b long")
    return found.filter(F.col("b").isNotNull()).select("a", "b").unionByName(rims).distinct()


def _all_links(reps: DataFrame, window: int, threshold: float, missed: float) -> DataFrame:
    """Stored: the links of as many passes as the largest and the most crowded label need.

    Further rounds of passes follow until one adds less than ``FRESH`` to the united vectors: what the count of passes
    takes for granted, that directions spread evenly about their mean, need not hold.
    """
    means = _means(reps)
    crowds = means.groupBy(F.ceil(F.log2("n")).alias("size")).agg(F.max("n").alias("n"), F.max("common").alias("common")).collect()
    passes = max((passes_for(c["n"], window, threshold, missed, c["common"]) for c in crowds), default=2)
    spread = F.col("rep")
    keyed = reps.withColumn("dim", F.size("v")).withColumn("place", F.struct("label", "dim"))
    means = stored(means.select(F.struct("label", "dim").alias("place"), "mean"), "vector-centres")
    centred = stored(join_facts(keyed, means, "place", spread).select("rep", "label", "v", "mean"), "vector-centred")
    done, step = passes, max(2, passes // 4)
    forest = _stars(_links(centred, range(passes), window, threshold))
    while True:
        size = forest.count()
        forest = _stars(forest.unionByName(_links(centred, range(done, done + step), window, threshold)))
        done += step
        if forest.count() - size <= FRESH * size:
            return forest


def _stars(links: DataFrame) -> DataFrame:
    """Stored: each united vector's link (a, b) to the smallest of its component, one row less than vectors."""
    tied = components(links, "a", "b").filter("node <> component")
    return stored(tied.select(F.col("node").alias("a"), F.col("component").alias("b")), "vector-stars")


def _count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """``rep`` and ``links``: the vectors linked to each, over all pairs within a component.

    A component's members are dealt over blocks, and every two blocks meet in a task of their own, which returns
    counts only.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    dealt = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other)
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    pairs = dealt.select("component", low, high, "own", "rep", "n", "v")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["rep", "own"])
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        a, b = rows[rows["own"] == low], rows[rows["own"] == high]
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "links": []}).astype("int64")
        close = _unit(a["v"].tolist()) @ _unit(b["v"].tolist()).T >= threshold
        if low == high:
            np.fill_diagonal(close, False)
            return pd.DataFrame({"rep": a["rep"].to_numpy(), "links": close @ a["n"].to_numpy()})
        return pd.DataFrame({
            "rep": np.concatenate([a["rep"], b["rep"]]),
            "links": np.concatenate([close @ b["n"].to_numpy(), close.T @ a["n"].to_numpy()]),
        })

    counted = pairs.groupBy("component", "low", "high").applyInPandas(count, "rep long, links long")
    return counted.groupBy("rep").agg(F.sum("links").alias("links"))


def _carried(vectors: DataFrame, vector_col: str) -> Column:
    """Vectors are carried as they are if they are floats or doubles; all sums are in double precision."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    return F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")


def _usable(id_col: str, vector_col: str, label_col: str) -> Column:
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists(vector_col, lambda x: x != 0)
    return F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~bad & nonzero, F.lit(False))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, window: int = WINDOW, missed: float = MISSED, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: its id, ``n_links`` (other vectors linked directly), ``component_id``, ``kept``.

    Two vectors of one label link when their cosine in double precision reaches the threshold.  Equal vectors are one
    class.  In each pass the classes are put in the order of their concatenated random projection signs, taken about the
    mean of their label, and every one is compared with its next ``window`` neighbours; pairs that reach the threshold
    are united over all passes.  The number of passes follows the largest label and the common direction of its
    vectors, so that a pair at the threshold is missed with a probability of at most ``missed`` while directions spread
    evenly about the mean; rounds of passes are added as long as they find more.  Within each united component all pairs are then compared in blocks, so the counts there are exact
    however dense it is; no pair below the threshold is linked.

    Null ids or labels, and vectors that are null, empty, zero, or hold null or non-finite components, link with
    nothing: no links, their own id as component, kept.  Labels are whole numbers.  Vectors of different sizes do not
    link.  An id that repeats counts as one node for each of its vectors' classes.  An empty table gives an empty
    result.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        _carried(vectors, vector_col).alias("v"),
    ).withColumn("usable", _usable("id", "v", "label"))
    usable = rows.filter("usable")
    reps = stored(usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    stars = _all_links(reps, window, threshold, missed)
    united = stored(
        stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()),
        "vector-components",
    )
    members = reps.join(united, reps["rep"] == united["node"]).select("component", "rep", "n", "v")
    links = _count_links(members, threshold, block)
    facts = reps.join(united, reps["rep"] == united["node"], "left").join(links, "rep", "left").select(
        "label", "v", F.coalesce("component", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
    )
    joined = usable.select("id", "label", "v").join(stored(facts, "vector-facts"), ["label", "v"]).select("id", "n_links", "component")
    alone = rows.filter(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
