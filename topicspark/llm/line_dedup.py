"""Repeated lines: hashes range-partitioned and sorted by document, answered by compressed bitmaps per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from topicspark.llm.common import SPACES, stored

LEAST_LENGTH = 20
LEAST_DOCUMENTS = 3
BLOCK_LINES = 1 << 19
_SPACE = SPACES.encode()
_NO_ID = -(1 << 63)
# What becomes of a line: still to be settled; the same, in a block with enough documents already; dropped.
_ASKED, _ENOUGH, _DROPPED = 0, 1, 2
_LINE = "a long, b long, doc long, tag long, at int, more binary, kind int"
_BITS = "doc long, tag long, bits binary"
_LEFT = StructType([StructField("dropped", LongType()), StructField("kept", StringType())])


def line_key(line: bytes) -> bytes:
    """A line as it is compared: without ASCII white space at both ends, A-Z in lower case."""
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _packed(rows: dict[str, np.ndarray], at: np.ndarray) -> pa.RecordBatch:
    kinds = {"more": pa.binary(), "kind": pa.int32(), "at": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v[at], kinds.get(k, pa.int64())) for k, v in rows.items()], list(rows))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns begins a new group."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _hash_lines(least: int, enough: int, block_lines: int):
    """One row per text and different key, settled within blocks of a task as far as a block can tell.

    A block that holds a key in enough documents drops it from all but the largest, whose row alone goes on.  So a
    line in a third of all documents leaves each block fewer than ``enough`` times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        codes, docs, tags, ats, mores = [], [], [], [], {}

        def block() -> pa.RecordBatch:
            code = np.frombuffer(b"".join(codes), "<i8").reshape(-1, 2)
            n = len(code)
            more = np.full(n, None, object)
            for i, places in mores.items():
                more[i] = np.array(places, "<u4").tobytes()
            rows = {
                "a": code[:, 0], "b": code[:, 1], "doc": np.array(docs, np.int64), "tag": np.array(tags, np.int64),
                "at": np.array(ats, np.int32), "more": more, "kind": np.zeros(n, np.int32),
            }
            order = np.lexsort((rows["doc"], rows["b"], rows["a"]))
            rows = {k: v[order] for k, v in rows.items()}
            new = _heads(rows["a"], rows["b"])
            heads, group = np.flatnonzero(new), np.cumsum(new) - 1
            count = np.add.reduceat(_heads(rows["a"], rows["b"], rows["doc"]).astype(np.int64), heads)
            last = np.append(heads[1:], n) - 1
            met = (count >= enough)[group]
            rows["kind"] = np.where(met, np.where(rows["doc"] < rows["doc"][last][group], _DROPPED, _ENOUGH), _ASKED)
            return _packed(rows, np.arange(n))

        for rows in batches:
            for doc, tag, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                seen: dict[bytes, int] = {}
                for at, line in enumerate(text.as_py().split(b"\n")):
                    if len(line) < least:
                        continue
                    key = line_key(line)
                    if not _long_enough(key, least):
                        continue
                    code = digest(key)
                    known = seen.setdefault(code, len(codes))
                    if known < len(codes):
                        mores.setdefault(known, []).append(at)
                    else:
                        codes.append(code)
                        docs.append(doc)
                        tags.append(tag)
                        ats.append(at)
                if len(codes) >= block_lines:
                    yield block()
                    codes, docs, tags, ats, mores = [], [], [], [], {}
        if codes:
            yield block()

    return run


def _stream(enough: int):
    """Rows in order of hash, document (largest first) and place: the first document of a hash keeps its lines, the
    others drop theirs if there are enough documents.  Gives the dropped rows."""
    fields = ("a", "b", "doc", "tag", "at", "more", "kind")

    def settled(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = _heads(rows["a"], rows["b"])
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        if not len(heads):
            return _packed(rows, heads)
        count = np.add.reduceat(_heads(rows["a"], rows["b"], rows["doc"]).astype(np.int64), heads)
        met = (count >= enough) | (np.maximum.reduceat(rows["kind"], heads) == _ENOUGH)
        dropped = met[group] & (rows["doc"] != rows["doc"][heads][group])
        return _packed(rows, np.flatnonzero(dropped))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in fields}
            if not len(rows["a"]):
                continue
            if rest is not None:
                rows = {k: np.concatenate([rest[k], v]) for k, v in rows.items()}
            cut = np.flatnonzero(_heads(rows["a"], rows["b"]))[-1]
            yield settled({k: v[:cut] for k, v in rows.items()})
            rest = {k: v[cut:] for k, v in rows.items()}
        if rest is not None:
            yield settled(rest)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places that a text drops as one compressed bitmap: a set bit keeps its line, lines beyond it are kept."""
    for rows in batches:
        out = []
        for ats, mores in zip(rows.column(2), rows.column(3), strict=True):
            places = np.concatenate([np.array(x, np.int64) for x in (ats.as_py(), *(np.frombuffer(m, "<u4") for m in mores.as_py()))])
            keep = np.ones(-(-(int(places.max()) + 1) // 8) * 8, bool)
            keep[places] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.binary())], ["doc", "tag", "bits"])


def kept_lines(bits: bytes, n_lines: int) -> np.ndarray:
    """Which of a text's lines a bitmap keeps; it ends at a byte, and lines beyond its end are kept."""
    known = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[:n_lines]
    keep = np.ones(n_lines, bool)
    keep[: len(known)] = known
    return keep


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc, tag and text; the tag tells texts of one id apart and is 0 as long as no id repeats."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), doc.alias("doc"), text.alias("text"))
    repeated = rows.groupBy("doc").count().filter("count > 1").limit(1).count() > 0
    return rows.withColumn("tag", F.xxhash64("text") if repeated else F.lit(0).cast("long"))


def keep_bitmaps(rows: DataFrame, least: int, enough: int, block_lines: int) -> DataFrame:
    """(doc, tag, bits) for the texts that lose lines; ``rows`` have doc, tag and text."""
    lines = rows.select("doc", "tag", F.col("text").cast("binary").alias("text"))
    lines = stored(lines.mapInArrow(_hash_lines(least, enough, block_lines), _LINE), "line-hashes")
    asked = lines.filter(F.col("kind") != _DROPPED).repartitionByRange("a", "b")
    asked = asked.sortWithinPartitions("a", "b", F.col("doc").desc(), "tag", "at")
    dropped = lines.filter(F.col("kind") == _DROPPED).unionByName(asked.mapInArrow(_stream(enough), _LINE))
    more = F.collect_list("more").alias("mores")
    return dropped.groupBy("doc", "tag").agg(F.collect_list("at").alias("ats"), more).mapInArrow(_bitmaps, _BITS)


@F.arrow_udf(_LEFT)
def _without(texts: pa.Array, bits: pa.Array) -> pa.Array:
    out = []
    for text, code in zip(texts, bits, strict=True):
        if not code.is_valid:
            out.append(None)
            continue
        lines = text.as_py().split("\n")
        keep = kept_lines(code.as_py(), len(lines))
        left = [line for line, kept in zip(lines, keep.tolist(), strict=True) if kept]
        out.append({"dropped": len(lines) - len(left), "kept": "\n".join(left)})
    return pa.array(out, pa.struct([("dropped", pa.int64()), ("kept", pa.string())]))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH,
    enough: int = LEAST_DOCUMENTS, block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """One row per input row: its id, ``n_lines`` (before dropping), ``n_dropped`` and ``kept`` (the lines left).

    A text is split at ``\\n``.  Lines are equal when they are without ASCII white space at both ends and with A-Z in
    lower case.  Keys of at least ``least`` code points in at least ``enough`` documents lose all their lines but those
    of the largest id that holds them.

    Keys are compared by 128-bit hashes.  What is shuffled is a hash and a place per text and key, by ranges of the
    hash; what comes back is a compressed bitmap for each text that loses lines, and only those texts pass through
    Python again.  Blocks settle what repeats within them first, so one line in a third of all documents is sent on
    fewer than ``enough`` times by a block of ``block_lines`` keys, and no range is filled by one line.

    A null text is an empty one; an empty text is one empty line.  Rows of one id are one document when documents are
    counted, and all of them keep the lines of which their id is the largest holder.  A null id is smaller than all
    others, and null ids count as one document.  Repeated rows come back as often as they came.  An empty table gives
    an empty result; other columns play no part.
    """
    rows = _rows(docs, id_col, text_col)
    bits = stored(keep_bitmaps(rows, least, enough, block_lines), "line-bitmaps")
    # Bitmaps grow with the texts, so they are merged at every size.
    marked = rows.join(bits.hint("merge"), ["doc", "tag"], "left")
    done = _without(F.when(F.col("bits").isNotNull(), F.col("text")), "bits").alias("done")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return marked.select("id", "text", breaks.cast("long").alias("breaks"), done).select(
        F.col("id").alias(id_col),
        (F.col("breaks") + 1).alias("n_lines"),
        F.coalesce("done.dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.coalesce("done.kept", "text").alias("kept"),
    )
