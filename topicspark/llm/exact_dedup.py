"""Exact duplicates: Patricia tries over whole normalised texts, with the owner at each terminal node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import SPACES, stored, text_of
from topicspark.llm.patricia import Patricia

TRIE_BYTES = 32 << 20
_LOCAL = "local long, id long, weight long, size long, bytes binary"
_MERGED = "local long, keep_id long, group_size long, text_sha256 binary"


def normalised(column: str = "text") -> Column:
    return F.translate(text_of(column), SPACES, "")


def _better(a: tuple, b: tuple) -> bool:
    """Whether (weight, id) ``a`` wins over ``b``: more weight, then the smaller id, null ids last."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


def _local_tries(limit: int):
    """Each task's own trie.  Gives a row for every input row, and one with the bytes for every terminal node.

    Past ``limit`` bytes the heaviest subtree leaves as rows, so a text met again later gets a second local number;
    the merge brings both together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, made = Patricia(), TaskContext.get().partitionId() << 33

        def ended(pairs) -> Iterator[pa.RecordBatch]:
            held, weight = [], 0
            for key, owner in pairs:
                held.append((*owner, key))
                weight += len(key)
                if weight > 4 << 20 or len(held) >= 10_000:
                    yield batch(*zip(*held, strict=True))
                    held, weight = [], 0
            if held:
                yield batch(*zip(*held, strict=True))

        def batch(local, ids, weights, sizes, texts) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(x, kind) for x, kind in zip((local, ids, weights, sizes, texts), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["local", "id", "weight", "size", "bytes"])

        for rows in batches:
            ids, weights = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            locals_ = []
            for row, (number, weight) in enumerate(zip(ids, weights, strict=True)):
                node = trie.node(rows.column(2)[row].as_py())
                owner = node.owner
                if owner is None:
                    node.owner = owner = [made, number, weight, 0]
                    made += 1
                elif _better((weight, number), (owner[2], owner[1])):
                    owner[1], owner[2] = number, weight
                owner[3] += 1
                locals_.append(owner[0])
                while trie.size > limit:
                    yield from ended(list(trie.cut_largest()))
            none = [None] * len(ids)
            yield batch(locals_, ids, weights, none, none)
        yield from ended(trie.drain())

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (length, hash): one such run is a subtree, closed as soon as the next begins."""
    trie, run = Patricia(), None

    def ended() -> Iterator[pa.RecordBatch]:
        out = [[], [], [], []]
        for key, (number, _, size, local) in trie.drain():
            digest = hashlib.sha256(key).digest()
            for values, value in zip(out, (local, [number] * len(local), [size] * len(local), [digest] * len(local)), strict=True):
                values.extend(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
        if out[0]:
            yield pa.RecordBatch.from_arrays(columns, ["local", "keep_id", "group_size", "text_sha256"])

    for rows in batches:
        heads = zip(*(rows.column(i).to_pylist() for i in range(6)), strict=True)
        for row, (length, code, local, number, weight, size) in enumerate(heads):
            if (length, code) != run:
                yield from ended()
                run = (length, code)
            node = trie.node(rows.column(6)[row].as_py())
            if node.owner is None:
                node.owner = [number, weight, 0, []]
            elif _better((weight, number), (node.owner[1], node.owner[0])):
                node.owner[:2] = number, weight
            node.owner[2] += size
            node.owner[3].append(local)
    yield from ended()


def exact_owners(
    docs: DataFrame, id_col: str = "doc_id", key: Column | None = None, weight: Column | None = None,
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """One row per input row: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the key's bytes).

    Rows are equal when ``key`` (by default the text without white space) has the same bytes; of equal rows the one
    with the largest ``weight`` (by default the code points of the text), then the smallest id, stays.

    Each task inserts the whole keys of its rows into a trie, so a text is shuffled once per task that holds it, with
    its best row and its count, however many copies there are.  Those terminal rows are dealt by length and content
    hash and merged in tries of their own.  The rows then meet their owner through their task-local number, which no
    more rows share than one task has read.

    Null texts count as empty, and empty texts are equal to each other.  A null id loses against any other and is kept
    only where all ids of its group are null; rows that repeat the kept id are all marked kept.  An empty table gives an
    empty result; other columns play no part.
    """
    weight = F.length(text_of()).cast("long") if weight is None else weight
    key = normalised() if key is None else key
    rows = docs.select(F.col(id_col).cast("long").alias("id"), weight.alias("weight"), F.encode(key, "utf-8").alias("bytes"))
    tries = stored(rows.mapInArrow(_local_tries(trie_bytes), _LOCAL), "exact-tries")
    heads = ("local", "id", "weight", "size")
    ends = tries.filter(F.col("bytes").isNotNull()).select(
        F.octet_length("bytes").alias("length"), F.xxhash64("bytes").alias("code"), *heads, "bytes"
    )
    merged = ends.repartition("length", "code").sortWithinPartitions("length", "code").mapInArrow(_merge, _MERGED)
    members = tries.filter(F.col("bytes").isNull()).select("local", F.col("id").alias(id_col))
    return members.join(merged, "local").select(
        id_col,
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs``, all columns, without the rows whose text another id owns.

    A row is found again by its id and the digest of its normalised text, so an id that repeats with another text is
    judged for each text by itself; rows that repeat the owner's id and text are the owner and stay.
    """
    owners = exact_owners(docs, id_col).filter(~F.col("kept"))
    lost = owners.select(F.col(id_col).alias("_lost_id"), F.col("text_sha256").alias("_lost_text")).distinct()
    digest = F.sha2(F.encode(normalised(), "utf-8"), 256)
    return docs.join(lost, docs[id_col].eqNullSafe(lost["_lost_id"]) & (digest == lost["_lost_text"]), "left_anti")
