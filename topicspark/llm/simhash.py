"""SimHash near-duplicates found by covering locality-sensitive hashing: no pair within the radius is missed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import stored, text_of
from topicspark.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as UTF-8: A-Z in lower case, words split at ASCII white space, shingles of words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``fp`` (the fingerprint's bits as a signed long) and ``tag`` (a hash of the text) of every row, without a
    shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            codes = [fingerprint(text.as_py(), shingle) for text in rows.column(1)]
            fps = np.array(codes, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps), rows.column(2)], ["id", "fp", "tag"])

    text = F.encode(text_of(text_col), "utf-8").alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text, F.xxhash64(text_of(text_col)).alias("tag"))
    return rows.mapInArrow(run, "id long, fp long, tag long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """``2^(radius+1) - 1`` bit masks such that any ``radius`` bit positions are all absent from at least one of them.

    Each position gets a non-zero vector of radius + 1 bits, dealt out evenly.  The mask of a non-zero vector v keeps
    the positions whose vector has an odd inner product with v.  Fewer than radius + 1 vectors cannot span the space,
    so some v is orthogonal to all of those at which two fingerprints differ: its mask keeps none of them.
    """
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))
    ]


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def _links(distinct: DataFrame) -> DataFrame:
    """Pairs (fp, least) within radius 2 whose transitive closure is that of all such pairs.

    Each fingerprint enters one bucket per mask, keyed by the bits the mask keeps.  Members of a bucket can differ only
    in the other bits; two of them are within two bits exactly if flipping at most one such bit of each gives the same
    number.  So the members of buckets with company give their single flips, and all who share a flip are tied to the
    smallest of them: the work is linear in a bucket's size, and no bucket is cut short.
    """
    masks = covering_masks(2)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)
    ])).alias("b")).select("fp", "b.t", "b.key")
    company = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    members = keyed.join(company, ["t", "key"])
    free = [[0] + [_signed(1 << i) for i in range(BITS) if not m >> i & 1] for m in masks]
    table = F.array(*[F.array(*[F.lit(x) for x in flips]) for flips in free])
    flips = members.select("fp", F.explode(F.element_at(table, F.col("t") + 1)).alias("flip"))
    flips = flips.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")).distinct()
    least = flips.groupBy("near").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1")
    pairs = flips.join(least, "near").filter("fp <> least").select("fp", "least").distinct()
    return pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= 2)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """One row per input row: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints that differ in at most 2 bits are linked; a component's number is its smallest id.  Equal fingerprints
    are one class from the start, so a group of copies costs its rows once, and links join classes only.

    Null and empty texts have fingerprint zero and are linked like any other.  Rows with a null id belong to their
    class; a component of null ids only has the component number null.  Repeated rows come back as often as they came.
    """
    code = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return _placed(docs, id_col, text_col, shingle).select(F.col("id").alias(id_col), code, "component_id")


def _placed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp, tag, component_id) of every row."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-classes")
    tied = components(_links(classes.select("fp")), "fp", "least")
    placed = classes.join(tied, classes["fp"] == tied["node"], "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    numbers = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_class = placed.join(numbers, "component").select("fp", "component_id")
    return prints.join(by_class, "fp")


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``docs``, all columns, without the rows whose component has a smaller id.

    A row is found again by its id and a hash of its text, so where an id repeats, or is null, each text is judged by
    itself.  Rows under the smallest id of their component all stay.  A component of null ids only stays whole, since
    nothing tells which to keep; a null id beside others goes.
    """
    groups = _placed(docs, id_col, text_col, shingle)
    lost = groups.filter(F.col("component_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("component_id")))
    lost = lost.select(F.col("id").alias("_lost_id"), F.col("tag").alias("_lost_tag")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(lost["_lost_id"]) & (F.xxhash64(text_of(text_col)) == lost["_lost_tag"])
    return docs.join(lost, same, "left_anti")
