"""Repeated passages: bytes covered by a string that starts in an earlier document too are removed.

Every window of ``length`` bytes is named by the smallest hash of the short strings in it, so equal windows have equal
names.  Consecutive windows of one name form a run.  Runs equal as a whole in two documents are settled by their hash;
runs that only share their name are laid out in blocks, where suffix arrays with the previous and the next smaller
document give longest-previous-factor arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import stored_tidily, text_of

LENGTH = 50
GRAM = 16
BLOCK_RUNS = 1 << 20
BLOCK_BYTES = 4 << 20
_ROWS = 1 << 15
SPANS = 64  # different runs of one name up to which a block sends them to the name's task
GROUP = 50_000  # different runs of one name up to which they are compared in one task
_LAST = (1 << 63) - 1


def _hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at each position."""
    raw = np.ascontiguousarray(text)
    n = len(raw) - GRAM + 1
    low = np.ndarray((n,), "<u8", raw.data, 0, (1,))
    high = np.ndarray((n,), "<u8", raw.data, 8, (1,))
    mixed = low * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed += high
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    return mixed


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by doubling."""
    covered = 1
    while 2 * covered <= width:
        values = np.minimum(values[:-covered], values[covered:])
        covered *= 2
    rest = width - covered
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_runs(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, first window and last window of every run of a text; none if it is shorter than a window."""
    if len(text) < length:
        none = np.empty(0, np.int64)
        return none, none, none
    names = _least(_hashes(np.frombuffer(text, np.uint8)), length - GRAM + 1)
    firsts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1])
    lasts = np.concatenate([firsts[1:] - 1, [len(names) - 1]])
    return names[firsts].view(np.int64), firsts, lasts


def suffix_array(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, given as rows of as many bytes, and the bytes that each shares with the one before."""
    n, length = suffixes.shape
    order = np.argsort(suffixes.view(f"S{length}").ravel(), kind="stable")
    shared = np.zeros(n, np.int32)
    for at in range(1, n, _ROWS):
        now, before = order[at : at + _ROWS], order[at - 1 : min(at + _ROWS, n) - 1]
        apart = suffixes[now] != suffixes[before]
        first = apart.argmax(axis=1)
        shared[at : at + _ROWS] = np.where(apart[np.arange(len(now)), first], first, length)
    return order, shared


def _smaller_before(docs: np.ndarray, shared: np.ndarray, least_length: int) -> np.ndarray:
    """For each place of the suffix order: what it shares with the nearest place before whose document is smaller.

    A place that points to one with no smaller document takes over where that one points, which lies beyond only
    documents as large; so pointers double their reach, and carry the least shared length on their way.  One that has
    fallen below ``least_length`` stops.
    """
    n = len(docs)
    to, least = np.arange(-1, n - 1), shared.copy()
    going = np.flatnonzero((to >= 0) & (least >= least_length))
    while True:
        going = going[docs[to[going]] >= docs[going]]
        if not len(going):
            break
        via = to[going]
        least[going] = np.minimum(least[going], least[via])
        to[going] = to[via]
        going = going[(to[going] >= 0) & (least[going] >= least_length)]
        # A place without anything smaller before it shares nothing.
        least[via[to[via] < 0]] = 0
    least[to < 0] = 0
    return np.where(docs[np.maximum(to, 0)] < docs, least, 0)


def longest_previous_factors(
    text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int, least_length: int = 1
) -> np.ndarray:
    """For every suffix: the length, up to ``length``, of its longest previous factor; where that is less than
    ``least_length``, some smaller length.

    ``starts`` are suffixes of ``text`` with at least ``length`` bytes, ``docs`` their documents.  A previous factor of
    a suffix is the longest string it shares with a suffix of a smaller document.  In suffix order it is shared with
    the nearest smaller document before or after: the previous or the next smaller value.
    """
    if not len(starts):
        return np.zeros(0, np.int32)
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    order, shared = suffix_array(np.ascontiguousarray(windows[starts]))
    docs = docs[order]
    before = _smaller_before(docs, shared, least_length)
    after = _smaller_before(docs[::-1], np.concatenate([[0], shared[:0:-1]]), least_length)[::-1]
    factors = np.empty(len(order), np.int32)
    factors[order] = np.maximum(before, after)
    return factors


def earlier_factors(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For every suffix: whether its longest previous factor reaches ``length``."""
    return longest_previous_factors(text, starts, docs, length, length) >= length


def _words(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes at each start as big-endian numbers, which compare as the bytes do."""
    windows = np.lib.stride_tricks.sliding_window_view(text, length)[starts]
    padded = np.zeros((len(starts), -(-length // 8) * 8), np.uint8)
    padded[:, :length] = windows
    return padded.view(">u8").astype(np.uint64)


def _packed(columns: dict[str, np.ndarray], at: np.ndarray | slice = slice(None)) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c[at]) for c in columns.values()], list(columns))


# What becomes of a run: to be compared by name; covered as a whole; compared with its name's others; by windows.
# A run sent with _MANY is compared by windows already and tells others of its name to be.
_ASKED, _COVERED, _TOGETHER, _WINDOWS, _MANY = 0, 1, 2, 3, 4
_RUN = "name long, span long, doc long, tag long, run int, kind int"


def _settle_block(rows: dict[str, np.ndarray], limit: int) -> Iterator[pa.RecordBatch]:
    """What a block can tell by itself, so that a name is sent on at most ``limit`` times for each block.

    Of equal runs those of a later document are covered.  A name with many different runs goes to the comparison by
    windows at once; one of its runs is still sent, for other blocks to learn of it.
    """
    order = np.lexsort((rows["doc"], rows["span"], rows["name"]))
    rows = {k: v[order] for k, v in rows.items()}
    new_name = np.concatenate([[True], rows["name"][1:] != rows["name"][:-1]])
    new_span = new_name | np.concatenate([[True], rows["span"][1:] != rows["span"][:-1]])
    first_doc = rows["doc"][np.flatnonzero(new_span)][np.cumsum(new_span) - 1]
    rows["kind"][:] = np.where(rows["doc"] > first_doc, _COVERED, _ASKED)
    spans = np.cumsum(new_span)
    name = np.cumsum(new_name) - 1
    heads = np.flatnonzero(new_name)
    nth = spans - spans[heads][name]
    many = (np.maximum.reduceat(nth, heads) >= limit)[name]
    asked = rows["kind"] == _ASKED
    told = asked & many
    yield _packed(rows, np.flatnonzero(~told))
    rows["kind"][told] = _MANY
    yield _packed(rows, np.flatnonzero(told & new_name))
    rows["kind"][told] = _WINDOWS
    yield _packed(rows, np.flatnonzero(told))


def _find_runs(length: int, block_runs: int, limit: int):
    """Runs of the texts of a task, settled in blocks.

    Equal texts of a block are one, under their smallest document: as sources of matches the others add nothing, and
    they are removed as copies anyway, whatever order the rows come in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, count = [], [], 0
        known: dict[bytes, int] = {}
        code = xxhash.xxh3_64_intdigest

        def block() -> Iterator[pa.RecordBatch]:
            names, spans = (np.concatenate(x) for x in zip(*held, strict=True))
            sizes = [len(x[0]) for x in held]
            docs, tags = (np.repeat(np.array(x, np.int64), sizes) for x in zip(*owners, strict=True))
            numbers = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            rows = {"name": names, "span": spans, "doc": docs, "tag": tags, "run": numbers, "kind": np.zeros(len(names), np.int32)}
            yield from _settle_block(rows, limit)

        for rows in batches:
            for doc, tag, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                view = memoryview(text.as_buffer())
                if len(view) < length:
                    continue
                at = known.setdefault(xxhash.xxh3_128_digest(view), len(held))
                if at < len(held):
                    owners[at] = min(owners[at], (doc, tag))
                    continue
                names, firsts, lasts = window_runs(view, length)
                ends = (lasts + length).tolist()
                codes = np.array([code(view[a:b]) for a, b in zip(firsts.tolist(), ends, strict=True)], np.uint64)
                held.append((names, codes.view(np.int64)))
                owners.append((doc, tag))
                count += len(names)
                if count >= block_runs:
                    yield from block()
                    held, owners, count = [], [], 0
                    known.clear()
        if held:
            yield from block()

    return run


def _settle_names(group: int):
    """Rows in order of name, span and document: the runs of a name are looked at together.

    A run that equals one of an earlier document is covered.  If a name has different runs, the earliest document of
    each is compared further.  A name that lacks company is dropped.
    """
    fields = ("doc", "tag", "run", "kind", "name")

    def settled(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(rows["name"]):
            return
        new_name = np.concatenate([[True], rows["name"][1:] != rows["name"][:-1]])
        new_span = new_name | np.concatenate([[True], rows["span"][1:] != rows["span"][:-1]])
        first_doc = rows["doc"][np.flatnonzero(new_span)][np.cumsum(new_span) - 1]
        heads, name = np.flatnonzero(new_name), np.cumsum(new_name) - 1
        told = np.maximum.reduceat((rows["kind"] == _MANY).astype(np.int64), heads)
        spans = np.add.reduceat(new_span.astype(np.int64), heads)
        further = np.where((told > 0) | (spans > group), _WINDOWS, np.where(spans > 1, _TOGETHER, _ASKED))[name]
        kind = np.where(rows["doc"] > first_doc, _COVERED, further).astype(np.int32)
        out = (kind != _ASKED) & (rows["kind"] != _MANY)
        yield _packed({k: rows[k] for k in ("doc", "tag", "run")} | {"kind": kind, "name": rows["name"]}, np.flatnonzero(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("name", "span", *fields[:4])}
            done = (rows["kind"] != _ASKED) & (rows["kind"] != _MANY)
            yield _packed({k: rows[k] for k in fields}, np.flatnonzero(done))
            rows = {k: v[~done] for k, v in rows.items()}
            if rest is not None:
                rows = {k: np.concatenate([rest[k], v]) for k, v in rows.items()}
            cut = np.searchsorted(rows["name"], rows["name"][-1], "left") if len(rows["name"]) else 0
            yield from settled({k: v[:cut] for k, v in rows.items()})
            rest = {k: v[cut:] for k, v in rows.items()}
        if rest is not None:
            yield from settled(rest)

    return run


_WINDOW = "code_a long, code_b long, doc long, tag long, at int, hit boolean, span binary"
_HIT = "doc long, tag long, first int, last int"


def _hit_rows(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
    """The chosen windows, those in a row together."""
    doc, tag, at = doc[chosen], tag[chosen], at[chosen]
    new = np.ones(len(doc) + 1, bool)
    new[1:-1] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] != at[:-1] + 1)
    first, last = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
    return _packed({"doc": doc[first], "tag": tag[first], "first": at[first].astype(np.int32), "last": at[last].astype(np.int32)})


def _laid_out(held: list[tuple[bytes, int, int, int]], length: int):
    """Runs (bytes, doc, tag, first window) end to end: the text, and start, doc, tag and place of every window."""
    text = np.frombuffer(b"".join([x[0] for x in held]), np.uint8)
    begins = np.cumsum([0, *[len(x[0]) for x in held[:-1]]])
    counts = np.array([len(x[0]) - length + 1 for x in held])
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    docs, tags, at = (np.repeat(np.array([x[i] for x in held], np.int64), counts) for i in (1, 2, 3))
    return text, np.repeat(begins, counts) + inside, docs, tags, at + inside


def _find_windows(length: int, block_bytes: int):
    """The runs to be compared with their name's others, and the windows of those to be compared by windows.

    The latter are put in suffix order block by block, so that a window is sent on once per block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> Iterator[pa.RecordBatch]:
            text, starts, docs, tags, at = _laid_out(held, length)
            words = _words(text, starts, length)
            code = [np.full(len(starts), seed, np.uint64) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344)]
            for i in range(words.shape[1]):
                for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    code[k] = (code[k] ^ words[:, i]) * np.uint64(factor)
                    code[k] ^= code[k] >> np.uint64(31 + k)
            columns = {
                "code_a": code[0].view(np.int64), "code_b": code[1].view(np.int64), "doc": docs, "tag": tags,
                "at": at.astype(np.int32), "hit": earlier_factors(text, starts, docs, length),
            }
            rows = _packed(columns)
            yield rows.append_column("span", pa.nulls(rows.num_rows, pa.binary()))

        for rows in batches:
            together = []
            for doc, tag, text, runs, names in zip(*(rows.column(i) for i in range(5)), strict=True):
                text, doc, tag = text.as_py(), doc.as_py(), tag.as_py()
                _, firsts, lasts = window_runs(text, length)
                for code, name in dict(zip(runs.as_py(), names.as_py(), strict=True)).items():
                    number, windows = code >> 1, code & 1
                    a, b = int(firsts[number]), int(lasts[number]) + length
                    if not windows:
                        together.append((name, 0, doc, tag, a, False, text[a:b]))
                        continue
                    held.append((text[a:b], doc, tag, a))
                    size += b - a
                    if size >= block_bytes:
                        yield from block()
                        held, size = [], 0
            if together:
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*together, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["code_a", "code_b", "doc", "tag", "at", "hit", "span"])
        if held:
            yield from block()

    return run


def _settle_windows(length: int, block_bytes: int):
    """Rows in order of code: runs of one name are compared in suffix order, of equal windows all but the first
    document's are hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, size = None, [], 0
        fields = ("doc", "tag", "at")

        def compared() -> pa.RecordBatch:
            text, starts, docs, tags, at = _laid_out([x[1:] for x in held], length)
            return _hit_rows(docs, tags, at, earlier_factors(text, starts, docs, length))

        for batch in batches:
            spans = batch.filter(batch.column("span").is_valid())
            for name, doc, tag, at, span in zip(*(spans.column(k).to_pylist() for k in ("code_a", *fields, "span")), strict=True):
                if size >= block_bytes and held[-1][0] != name:
                    yield compared()
                    held, size = [], 0
                held.append((name, span, doc, tag, at))
                size += len(span)
            batch = batch.filter(batch.column("span").is_null())
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("code_a", "code_b", *fields, "hit")}
            yield _hit_rows(*(rows[k] for k in fields), rows["hit"])
            rows = {k: v[~rows["hit"]] for k, v in rows.items()}
            if not len(rows["doc"]):
                continue
            a, b, doc = rows["code_a"], rows["code_b"], rows["doc"]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            if before is not None and before[:2] == (a[0], b[0]):
                first[np.cumsum(new) == 1] = before[2]
            before = (a[-1], b[-1], first[-1])
            yield _hit_rows(*(rows[k] for k in fields), doc > first)
        if held:
            yield compared()

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for i, text, copy, runs, at in zip(*(rows.column(i) for i in range(5)), strict=True):
                text, copy, runs, at = text.as_py(), copy.as_py(), runs.as_py(), at.as_py()
                n = len(text)
                edges = np.zeros(n + 1, np.int32)
                if copy and n >= length:
                    edges[0], edges[n] = 1, -1
                if runs:
                    _, firsts, lasts = window_runs(text, length)
                    runs = np.unique(runs)
                    np.add.at(edges, firsts[runs], 1)
                    np.add.at(edges, lasts[runs] + length, -1)
                if at:
                    at = np.unique(at)
                    np.add.at(edges, at >> 32, 1)
                    np.add.at(edges, (at & 0xFFFFFFFF) + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                begun = np.concatenate([[False], gone])
                out.append((i.as_py(), n, n - len(left), int((gone & ~begun[:-1]).sum()), left))
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _settled_runs(rows: DataFrame, length: int, block_runs: int, spans: int, group: int) -> DataFrame:
    """Stored: (doc, tag, run, kind, name) of the runs that are covered or have to be compared further."""
    found = rows.select("doc", "tag", "text").mapInArrow(_find_runs(length, block_runs, spans), _RUN)
    # A row that is settled goes anywhere; the others meet at their name.
    meets = F.col("kind").isin(_ASKED, _MANY)
    met = found.repartition(F.when(meets, F.col("name")).otherwise(F.xxhash64("doc", "run")))
    met = met.sortWithinPartitions("name", "span", "doc")
    return stored_tidily(met.mapInArrow(_settle_names(group), "doc long, tag long, run int, kind int, name long"), "passage-runs")


def _settled_windows(rows: DataFrame, settled: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Stored: (doc, tag, first, last) of the windows that an earlier document has, from runs equal in part only."""
    code = (F.col("run").cast("long") * 2 + (F.col("kind") == _WINDOWS).cast("int")).alias("code")
    asked = settled.filter(F.col("kind").isin(_TOGETHER, _WINDOWS)).select("doc", "tag", code, "name")
    asked = asked.groupBy("doc", "tag").agg(F.collect_list(F.struct("code", "name")).alias("runs"))
    texts = rows.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "runs.code", "runs.name")
    windows = texts.mapInArrow(_find_windows(length, block_bytes), _WINDOW)
    met = windows.repartition(F.when(F.col("hit"), F.xxhash64("doc", "at")).otherwise(F.col("code_a")))
    met = met.sortWithinPartitions("code_a", "code_b", "doc", "at")
    return stored_tidily(met.mapInArrow(_settle_windows(length, block_bytes // 4), _HIT), "passage-windows")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    block_runs: int = BLOCK_RUNS, block_bytes: int = BLOCK_BYTES, spans: int = SPANS, group: int = GROUP,
) -> DataFrame:
    """One row per input row: its id, n_bytes, n_removed, n_spans (maximal removed stretches) and ``kept`` (bytes).

    Removed is each byte that a ``length``-byte string covers which also starts in a document with a smaller id; what
    is compared is the input.  Matches do not cross documents.

    A text equal to that of a smaller id goes as a whole, by its digest.  Everywhere else runs and windows meet in
    shuffles that carry hashes; each task first settles what repeats within its own blocks, so a passage in a third of
    all documents reaches a shuffle once per block.  No bucket is cut.

    A null text is an empty one; texts shorter than ``length`` keep all bytes.  A null id counts as larger than all
    others.  Equal ids are not smaller than each other; rows that repeat an id with another text are told apart by a
    hash of the text.  An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
        F.encode(text_of(text_col), "utf-8").alias("text"),
    )
    repeated = rows.groupBy("doc").count().filter("count > 1").limit(1).count() > 0
    rows = rows.withColumn("tag", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    settled = _settled_runs(rows, length, block_runs, spans, group)
    windows = _settled_windows(rows, settled, length, block_bytes)
    covered = settled.filter(F.col("kind") == _COVERED).select("doc", "tag", "run")
    whole = rows.select("doc", "tag", F.unhex(F.sha2("text", 256)).alias("sha"))
    firsts = stored_tidily(whole.groupBy("sha").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1"), "passage-copies")
    copies = whole.join(firsts, "sha").filter("doc > first").select("doc", "tag").distinct().withColumn("copy", F.lit(True))
    runs = covered.groupBy("doc", "tag").agg(F.collect_set("run").alias("runs"))
    at = F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")
    at = windows.groupBy("doc", "tag").agg(F.collect_list(at).alias("at"))
    marks = runs.join(at, ["doc", "tag"], "full").join(copies, ["doc", "tag"], "full")
    # A copy is removed as a whole, whatever else is known of it.
    lists = [F.when(F.col("copy").isNull(), F.col(c)).alias(c) for c in ("runs", "at")]
    marks = stored_tidily(marks.select("doc", "tag", "copy", *lists), "passage-marks")
    marked = rows.join(marks, ["doc", "tag"], "left").select("id", "text", "copy", "runs", "at")
    out = marked.mapInArrow(_remove(length), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
