"""Spelling variants: words one edit apart, found by Gram matrices over blocks of letter counts."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import stored

LEAST_LENGTH = 5
LEAST_COUNT = 3
THINNED = 97
STRONGER = 2
HELD_WORDS = 400_000  # different words that a task holds before it sends them on
BUFFER = 512  # words on one side of a matrix product
GROUP = 4096  # words of a block up to which one task compares them all
PARTS = 4
# A block's words agree in the letter counts of two parts of the alphabet.  One edit changes two parts at most.
_BLOCKS = list(itertools.combinations(range(PARTS), 2))
# For each set of equal parts (as bits): the first block that holds both words; -1 if none does.
_FIRST_BLOCK = np.array(
    [next((i for i, b in enumerate(_BLOCKS) if all(s >> p & 1 for p in b)), -1) for s in range(1 << PARTS)]
)
_DIMENSIONS = 32
_LONG = 64  # bytes of a word beyond which pairs are verified one by one
# In Latin-1: A-Z in lower case, a-z and U+00C0 to U+00FF stay, all else parts words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_LETTERS = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)
_NEAR = "word string, n long, near long, best_n long, best string"


def runs_of(text: str) -> list[bytes]:
    """A text's runs of letters in Latin-1, A-Z in lower case; every character of a run is one byte."""
    return text.encode("latin-1", "replace").translate(_WORD_BYTES).split()


def thinned(begin: int, run: bytes) -> bytes:
    """The run, without one code point where the checksum of ``id:run`` is divisible by THINNED; ``begin`` is that of
    ``id:``."""
    code = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
    if code % THINNED:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def _count_words(least: int, held: int):
    """Occurrences per word of what a task reads, sent on whenever ``held`` words are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            words = [w for w in counts if len(w) >= least]
            columns = [pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([counts[w] for w in words], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                begin = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                for word, n in Counter(runs_of(text.as_py())).items():
                    if len(word) < least:
                        continue
                    counts[thinned(begin, word)] += n
                if len(counts) >= held:
                    yield sent()
        yield sent()

    return run


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, held: int = HELD_WORDS
) -> DataFrame:
    """(word, n) over all texts, words of at least ``least`` code points only."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(_count_words(least, held), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced code point (a byte each) parts two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def part_sums(words: list[bytes]) -> np.ndarray:
    """For each (non-empty) word and part of the alphabet: a number for the part's letter counts."""
    letters = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum([0, *map(len, words[:-1])])
    codes, part = _LETTERS[letters], letters % PARTS
    return np.stack([np.add.reduceat(np.where(part == p, codes, np.uint64(0)), starts) for p in range(PARTS)], axis=1)


class Words:
    """Words as matrices: letter counts, the hashes of their parts, and their letters from both ends."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        n = len(words)
        letters = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), self.length)
        # Letters that share a dimension bring words closer together, never apart.
        self.counts = np.bincount(row * _DIMENSIONS + letters % _DIMENSIONS, minlength=n * _DIMENSIONS).reshape(n, _DIMENSIONS)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        width = min(int(self.length.max(initial=1)), _LONG)
        self.left, self.right = (np.zeros((n, width), np.uint8) for _ in range(2))
        inside = place < width
        self.left[row[inside], place[inside]] = letters[inside]
        back = self.length[row] - 1 - place
        inside = back < width
        self.right[row[inside], back[inside]] = letters[inside]
        self.parts = part_sums(words)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: whether one edit parts the two."""
        longer = np.maximum(self.length[a], self.length[b])
        head = np.cumprod(self.left[a] == self.left[b], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
        tail = np.cumprod(self.right[a] == self.right[b], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
        # A row's zeros beyond its end equal no letter; where both have ended they count as equal.
        shorter = np.minimum(self.length[a], self.length[b])
        out = np.minimum(head, shorter) + np.minimum(tail, shorter) >= longer - 1
        for i in np.flatnonzero(longer > self.left.shape[1]):
            out[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return out


def _block_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word once for each block that it is in."""
    for rows in batches:
        words = [w.encode("latin-1") for w in rows.column(0).to_pylist()]
        if not words:
            continue
        parts = part_sums(words)
        for at, (i, j) in enumerate(_BLOCKS):
            code = pa.array(_block_codes(parts[:, i], parts[:, j]).view(np.int64))
            columns = [pa.array(np.full(len(words), at, np.int32)), code, rows.column(0), rows.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "code", "word", "n"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (block, code, low, high, length): near words within each group, summed per word.

    Groups are buffered to a few hundred words, so that small ones share a product.  The rows of a buffer are
    multiplied with the band of rows that follow, up to those one letter longer in the last row's group.
    """
    fields = ("block", "code", "low", "high", "tile")

    def compared(rows: dict) -> pa.RecordBatch:
        words = Words([w.encode("latin-1") for w in rows["word"]])
        n, count = len(words.words), np.array(rows["n"], np.int64)
        block, code, low, high, tile = (np.asarray(rows[k]) for k in fields)
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (block, code, low, high)])
        group = np.cumsum(new)
        kind = np.float32 if words.length.max() < 1000 else np.float64
        vectors = words.counts.astype(kind)
        half = (vectors * vectors).sum(axis=1, keepdims=True) / 2
        one = np.ones((n, 1), kind)
        # The product of a left and a right row is minus half the squared distance.
        left, right = np.hstack([vectors, -half, one]), np.hstack([vectors, one, -half])
        place = group * (int(words.length.max()) + 2) + words.length
        found_a, found_b = [], []
        for begin in range(0, n, BUFFER):
            end = min(begin + BUFFER, n)
            stop = int(np.searchsorted(place, place[end - 1] + 1, "right"))
            for start in range(begin, stop, 4 * BUFFER):
                a, b = np.nonzero(left[begin:end] @ right[start : min(start + 4 * BUFFER, stop)].T >= -1)
                a, b = a + begin, b + start
                ok = (a < b) & (group[a] == group[b]) & (words.length[b] - words.length[a] <= 1)
                # Of two tiles, only pairs with a word in each.
                ok &= (low[a] == high[a]) | (tile[a] != tile[b])
                a, b = a[ok], b[ok]
                equal = (words.parts[a] == words.parts[b]) @ (1 << np.arange(PARTS))
                # An edit leaves the first or the last letters alone.
                half_length = np.minimum(words.length[a] // 2, 4)
                ok = (_FIRST_BLOCK[equal] == block[a]) & (equal < (1 << PARTS) - 1)
                a, b, half_length = a[ok], b[ok], half_length[ok]
                ok = np.zeros(len(a), bool)
                for side in (words.left, words.right):
                    same = np.ones(len(a), bool)
                    for i in range(4):
                        same &= (side[a, min(i, side.shape[1] - 1)] == side[b, min(i, side.shape[1] - 1)]) | (i >= half_length)
                    ok |= same
                a, b = a[ok], b[ok]
                ok = words.near(a, b)
                found_a.append(a[ok])
                found_b.append(b[ok])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        word, other = np.concatenate([a, b]), np.concatenate([b, a])
        spelled = np.array(words.words, object)
        # Per word the near word that occurs most often, then the first in code-point order.
        by_name = np.empty(n, np.int64)
        by_name[np.array(sorted(range(n), key=words.words.__getitem__), np.int64)] = np.arange(n)
        order = np.lexsort((by_name[other], -count[other], word))
        word, other = word[order], other[order]
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
        sizes = np.diff(np.append(heads, len(word)))
        own, best = word[heads], other[heads]
        named = [pa.array([w.decode("latin-1") for w in spelled[x]], pa.string()) for x in (own, best)]
        columns = [named[0], pa.array(count[own]), pa.array(sizes), pa.array(count[best]), named[1]]
        return pa.RecordBatch.from_arrays(columns, ["word", "n", "near", "best_n", "best"])

    def cut(held: list[pa.Table]) -> tuple[pa.Table, pa.Table]:
        """All whole groups, and the last group, which may go on."""
        table = pa.concat_tables(held).combine_chunks()
        keys = [table.column(k).to_numpy() for k in fields[:4]]
        last = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        at = int(last[-1]) + 1 if len(last) else 0
        return table.slice(0, at), table.slice(at)

    held: list[pa.Table] = []
    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        waiting += max(batch.num_rows, batch.nbytes // (2 * _LONG))
        if waiting >= 4 * GROUP:
            whole, rest = cut(held)
            if whole.num_rows:
                yield compared(whole.to_pydict())
            held, waiting = [rest], rest.num_rows
    if waiting:
        yield compared(pa.concat_tables(held).to_pydict())


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, form_n, form) for stored (word, n): how many words are one edit away, and the most frequent.

    Two words one edit apart have the letter counts of at least two of the alphabet's four parts in common, so they
    meet in the block of those two; a pair in several blocks counts in the first.  A block with more than ``group``
    words is dealt into tiles, and each pair of tiles is a group of its own.
    """
    keyed = stored(words.mapInArrow(_keyed, "block int, code long, word string, n long"), "word-blocks")
    crowded = keyed.groupBy("block", "code").count().filter(F.col("count") > group)
    crowded = stored(crowded.select("block", "code", F.ceil(F.col("count") / group).cast("int").alias("tiles")), "word-crowds")
    dealt = keyed.join(crowded, ["block", "code"], "left").fillna(1, ["tiles"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("block", "code", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "word", "n")
    keys = ["block", "code", "low", "high"]
    met = dealt.repartition(*keys).sortWithinPartitions(*keys, F.length("word")).mapInArrow(_compare, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    met = met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return met.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.word").alias("form"))


def spelling_forms(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, stronger: int = STRONGER, group: int = GROUP,
) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    Runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case are words once ``thinned`` has taken a code point from
    one in 97 of them by id; counted are words of at least ``least_length`` code points and ``least_count``
    occurrences.  A word's form is the most frequent word one edit away (ties: first in code-point order) if it occurs
    ``stronger`` times as often, else null; the root is where the forms end, the word itself without one.

    Candidates are pairs of a block at most one letter apart in length whose letter counts have a squared distance of
    at most two; every one of them is verified.  Forms have larger counts, so following them ends; roots come from
    doubling the steps, in rounds that grow with the logarithm of the longest chain.

    A null or empty text has no words; a null id is written as nothing before the colon.  Words of any length are
    compared.  Repeated rows count again.  An empty table gives an empty result; other columns play no part.
    """
    words = word_counts(docs, id_col, text_col, least_length).filter(F.col("n") >= least_count)
    words = stored(words, "words")
    near = words.join(near_words(words, group), "word", "left")
    taken = F.col("form_n") >= F.lit(stronger) * F.col("n")
    forms = near.select(
        "word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("form_n")).alias("form_n"),
    )
    forms = stored(forms, "word-forms")
    steps = stored(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "word-steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = stored(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-steps")
        moved = steps.filter("moved").limit(1).count()
        steps = steps.drop("moved")
        if not moved:
            break
    return forms.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
