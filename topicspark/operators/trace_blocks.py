"""A trace index: for each block of offsets, which four-byte strings its keys and values hold, as a Bloom filter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.operators.shared import checkpointed

BLOCK = 1024
BITS = 1 << 16
GRAM = 4
HELD_BLOCKS = 2048  # blocks that a task holds before it sends them on
RANGES = 200  # ranges of offsets up to which the scan itself is narrowed; beyond that blocks are joined
_SCHEMA = "topic string, partition int, block long, block_size long, last_offset long, escaped boolean, bits array<long>"
# What a text at a path may stand in another way with: JSON escapes, and XML, whose nodes put texts together.
_ESCAPES = re.compile(rb"\\|^[\x00-\x20]*<")
_PLAIN_RUN = re.compile(rb"[A-Za-z0-9_-]{4,}")
# Without another letter a run could be a number, which may be written in another way.
_LETTER = re.compile(rb"[A-DF-Za-df-z]")


def _places(grams: np.ndarray, bits: int) -> np.ndarray:
    """Two bits for each four-byte string, given as a number."""
    shift = np.uint32(32 - (bits - 1).bit_length())
    first = grams * np.uint32(0x9E3779B1)
    second = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    second ^= second >> np.uint32(13)
    second *= np.uint32(0xC2B2AE35)
    return np.concatenate([first >> shift, second >> shift])


def _grams(text: bytes) -> np.ndarray:
    if len(text) < GRAM:
        return np.empty(0, np.uint32)
    return np.ndarray((len(text) - GRAM + 1,), "<u4", text, 0, (1,)).astype(np.uint32)


def _mark(block: int, bits: int):
    """Each task's filters, one row per block that it has records of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def sent() -> pa.RecordBatch:
            keys, cells = list(held), list(held.values())
            columns = [
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.int64()), pa.array([block] * len(keys), pa.int64()),
                pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.bool_()),
                pa.array([np.packbits(c[2], bitorder="little").view("<i8") for c in cells], pa.list_(pa.int64())),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["topic", "partition", "block", "block_size", "last_offset", "escaped", "bits"])

        for rows in batches:
            heads = zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True)
            for (topic, partition, offset), key, value in zip(heads, rows.column(3), rows.column(4), strict=True):
                place = topic, partition, offset // block
                cell = held.get(place)
                if cell is None:
                    if len(held) >= HELD_BLOCKS:
                        yield sent()
                    cell = held[place] = [offset, False, np.zeros(bits, bool)]
                cell[0] = max(cell[0], offset)
                for text in (key.as_py(), value.as_py()):
                    if text is not None:
                        cell[2][_places(_grams(text), bits)] = True
                        cell[1] = cell[1] or _ESCAPES.search(text) is not None
        if held:
            yield sent()

    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of topic, partition and block: the filters of a block become one."""
    now, cell = None, None

    def row() -> pa.RecordBatch:
        columns = [[x] for x in (*now, *cell)]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
        names = ["topic", "partition", "block", "block_size", "last_offset", "escaped", "bits"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for rows in batches:
        heads = zip(*(rows.column(i).to_pylist() for i in range(6)), strict=True)
        for (topic, partition, block, size, last, escaped), bits in zip(heads, rows.column(6), strict=True):
            place, bits = (topic, partition, block), np.asarray(bits.values)
            if place != now:
                if now is not None:
                    yield row()
                now, cell = place, [size, last, escaped, bits]
            else:
                cell = [size, max(cell[1], last), cell[2] or escaped, cell[3] | bits]
    if now is not None:
        yield row()


def trace_index(log: DataFrame, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """The index of a log: one row per topic, partition and block of ``block`` offsets.

    ``bits`` (a power of two of at least 64) is the size of a block's filter; a block that fills it is always read.
    Save the result beside the log.  Records that come later are found without it, so it can be made again at any
    time; a filter takes ``bits / 8`` bytes, whatever the block holds.
    """
    if bits < 64 or bits & (bits - 1):
        raise ValueError(f"bits must be a power of two of at least 64, not {bits}")
    texts = log.select("topic", "partition", "offset", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    marked = texts.mapInArrow(_mark(block, bits), _SCHEMA)
    order = ["topic", "partition", "block"]
    return marked.repartition(*order).sortWithinPartitions(*order).mapInArrow(_unite, _SCHEMA)


def _needed(key: str, path: str | None) -> np.ndarray:
    """The four-byte strings that a matching record must hold as they stand."""
    text = key.encode("utf-8")
    if path is None or not path.strip():
        return np.unique(_grams(text))
    # A run with a letter lies within one JSON string.
    runs = [_grams(run) for run in _PLAIN_RUN.findall(text) if _LETTER.search(run)]
    return np.unique(np.concatenate(runs)) if runs else np.empty(0, np.uint32)


def may_hold(log: DataFrame, index: DataFrame, key: str, path: str | None = None) -> DataFrame:
    """The records of ``log`` that could match ``key``: those of blocks whose filter has all of the key's four-byte
    strings, and those behind the index's end.

    With a ``path`` only strings that no JSON writer may spell in another way count, and blocks that hold an escape or
    an XML value are read in any case.  A key without such a string gives the whole log.  Few ranges of offsets go into the
    scan's filters, which skip files and row groups of a log that is laid out by offset; many are joined.
    """
    grams = _needed(key, path)
    if not len(grams):
        return log
    bits = index.select(F.size("bits").alias("words")).first()
    if bits is None:
        return log
    at = np.unique(_places(grams, bits["words"] * 64)).tolist()
    held = reduce(lambda a, b: a & b, [F.call_function("getbit", F.get("bits", F.lit(p // 64)), F.lit(p % 64)) == 1 for p in at])
    if path is not None and path.strip():
        held = held | F.col("escaped")
    size = F.col("block_size")
    found = checkpointed(index.filter(held).select("topic", "partition", (F.col("block") * size).alias("lo"), ((F.col("block") + 1) * size - 1).alias("hi")))
    ends = checkpointed(index.groupBy("topic", "partition").agg((F.max("last_offset") + 1).alias("lo")))
    open_end = ends.withColumn("hi", F.lit((1 << 63) - 1).cast("long"))
    ranges = found.unionByName(open_end)
    known = ends.groupBy("topic").agg(F.collect_list("partition").alias("partitions"))
    if ranges.limit(RANGES + 1).count() > RANGES or known.limit(RANGES + 1).count() > RANGES:
        return _joined(log, index, found, ends)
    inside = [(r["topic"], r["partition"], r["lo"], r["hi"]) for r in ranges.collect()]
    topics = {r["topic"]: r["partitions"] for r in known.collect()}

    def within(partition: int, lo: int, hi: int) -> Column:
        return (F.col("partition") == partition) & (F.col("offset") >= lo) & (F.col("offset") <= hi)

    new_topic = ~F.col("topic").isin(list(topics))
    exact = [(F.col("topic") == t) & within(p, lo, hi) for t, p, lo, hi in inside]
    exact += [(F.col("topic") == t) & ~F.col("partition").isin(ps) for t, ps in topics.items()]
    rows = log.filter(reduce(or_, exact, new_topic))
    every = sorted(set.intersection(*(set(ps) for ps in topics.values())))
    if log.select("topic").filter(new_topic).limit(1).count() == 0:
        # The same without topics, which are folders: this much of it reaches the files' statistics.
        anywhere = [within(p, lo, hi) for _, p, lo, hi in inside]
        rows = rows.filter(reduce(or_, anywhere, _others(every)))
    return rows


def _others(partitions: list[int]) -> Column:
    """Whether the partition is none of these, in comparisons that a file's statistics can answer."""
    if not partitions:
        return F.lit(True)
    place = F.col("partition")
    gaps = [(place > a) & (place < b) for a, b in zip(partitions, partitions[1:], strict=False) if b - a > 1]
    return reduce(or_, gaps, (place < partitions[0]) | (place > partitions[-1]))


def _joined(log: DataFrame, index: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """The same by joins: the records of found blocks, and those at or behind their partition's end."""
    size = index.agg(F.max("block_size")).first()[0]
    blocks = found.select("topic", "partition", (F.col("lo") / size).cast("long").alias("_block"))
    before = log.withColumn("_block", F.expr(f"`offset` div {size}")).join(ends.withColumnRenamed("lo", "_end"), ["topic", "partition"], "left")
    late = before.filter("_end IS NULL OR `offset` >= _end")
    hit = before.filter("`offset` < _end").join(blocks, ["topic", "partition", "_block"], "left_semi")
    return hit.unionByName(late.select(*hit.columns)).select(*log.columns)
