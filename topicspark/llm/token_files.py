"""Token ids as ORC: stripes with run-length encoded integers, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import itertools
import os
import string
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicspark.llm.common import text_of

# Words in an encoder's table before it starts anew; longer ones are not kept.
CACHED, LONG = 1_000_000, 40
# Texts are encoded together up to so many code points.
TOGETHER = 1 << 14
# Stripes of 8 MB can be read by tasks of their own; the index has an entry for every 1,000 documents.
ORC_OPTIONS = {
    "orc.stripe.size": str(8 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}
_SCHEMA = "doc_id long, at long, n_tokens long, ids array<int>"
# White space to str.split but not to the tokenizer.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"


class WordEncoder:
    """The ``tokenizers`` library's encoding of whole texts, with equal words looked up.

    Holds for tokenizers whose words never cross white space: texts are cut at white space and the words not in the table
    go through the tokenizer, those of several texts in one call.  A word of letters only, which is one word to the
    tokenizer, goes to its model without the steps before it, if the model marks the last piece of a word; ASCII marks
    that end a word are encoded by themselves.
    """

    def __init__(self, path: str, cached: int = CACHED):
        # The tasks of an executor share its cores already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.words: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.speller = Tokenizer(self.tokenizer.model)
        self.speller.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        if suffix:
            self.last[[number for piece, number in vocabulary.items() if piece.endswith(suffix)]] = True
        self.plain = bool(suffix) and self._agrees("azé", "ßñ", "ö")
        alone = self._whole("az")
        self.marks = "".join([c for c in string.punctuation if self._whole("az" + c) == alone + self._whole(c)])

    def _agrees(self, *words: str) -> bool:
        try:
            return self._spelled([*words]) == [self._whole(word) for word in words]
        except Exception as error:
            raise ValueError("the tokenizer's model cannot be used by itself") from error

    def _spelled(self, words: list[str]) -> list[bytes] | None:
        """The model's ids of words of lower-case letters in normal form; None if it does not mark their last pieces."""
        spelled = " ".join(words)
        if not spelled.isascii():
            spelled = _BYTE_CHARS[np.frombuffer(spelled.encode("utf-8"), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.speller.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = [0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()]
        if len(ends) != len(words) + 1 or ends[-1] != 4 * len(ids):
            return None
        packed = ids.tobytes()
        return [packed[a:b] for a, b in itertools.pairwise(ends)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _end(self, marks: str) -> bytes:
        packed = self.ends.get(marks)
        if packed is None:
            packed = self._whole(marks)
            if len(marks) <= LONG and len(self.ends) < self.cached:
                self.ends[marks] = packed
        return packed

    def _lower(self, cores: list[str]) -> list[str] | None:
        """Words of letters as the tokenizer lowers them, if normal and without İ; None if they may not stay letters."""
        # Character by character, so a last Σ is no exception.
        joined = " ".join(cores).replace("Σ", "σ").lower()
        return joined.split(" ") if joined.replace(" ", "").isalpha() else None

    def _encode_letters(self, cores: list[str], known: dict[str, bytes]) -> list[bytes] | None:
        """The ids of words of letters by their lower-case forms; those in ``known`` are not in the table.

        None if the words cannot be told apart in what the model returns.
        """
        lower = self._lower(cores)
        if lower is None:
            return None
        forms = dict.fromkeys(lower)
        elsewhere = [form for form in forms if form not in known]
        forms.update(zip(elsewhere, map(self.words.get, elsewhere), strict=True))
        new = [form for form, packed in forms.items() if packed is None]
        found = self._spelled(new) if new else []
        if found is None:
            return None
        forms.update(zip(new, found, strict=True))
        self.words.update([(form, forms[form]) for form in elsewhere if len(form) <= LONG])
        return [*map(forms.__getitem__, lower)]

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of words that the table does not have, which it gets."""
        known: dict[str, bytes] = dict.fromkeys(missing, b"")
        missing = [*known]
        cores = [word.rstrip(self.marks) for word in missing]
        sure = [self.plain and core.isalpha() for core in cores]
        joined = " ".join(itertools.compress(cores, sure))
        if "İ" in joined or not unicodedata.is_normalized("NFC", joined):
            sure = [
                ok and "İ" not in core and unicodedata.is_normalized("NFC", core)
                for ok, core in zip(sure, cores, strict=True)
            ]
        letters = [*itertools.compress(cores, sure)]
        packed = self._encode_letters(letters, known) if letters else []
        if packed is None:
            sure, letters, packed = [False] * len(missing), [], []
        plain = [*itertools.compress(missing, sure)]
        known.update(zip(plain, packed, strict=True))
        for word, core in zip(plain, letters, strict=True):
            if word != core:
                known[word] += self._end(word[len(core) :])
        odd = [word for word, ok in zip(missing, sure, strict=True) if not ok]
        for word, encoding in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[word] = np.array(encoding.ids, dtype="<u4").tobytes()
        self.words.update([(word, packed) for word, packed in known.items() if len(word) <= LONG])
        return known

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for some in _together(texts):
            split = [None if any([c in text for c in _ODD_SPACE]) else text.split() for text in some]
            words = [*itertools.chain.from_iterable([cut for cut in split if cut])]
            found = [*map(self.words.get, words)]
            missing = [i for i, packed in enumerate(found) if packed is None]
            if missing:
                if len(self.words) >= self.cached:
                    self.words.clear()
                learnt = self._learn([words[i] for i in missing])
                for i in missing:
                    found[i] = learnt[words[i]]
            at = 0
            for text, cut in zip(some, split, strict=True):
                if cut is None:
                    out.append(self._whole(text))
                else:
                    out.append(b"".join(found[at : at + len(cut)]))
                    at += len(cut)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, several at a time up to TOGETHER code points."""
    some, held = [], 0
    for text in texts:
        if some and held + len(text) > TOGETHER:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some


def _byte_chars() -> np.ndarray:
    """The byte-level step's character of each byte, as UTF-16: printable Latin-1 stands for itself, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    chars = np.array([b if b in shown else next(rest) for b in range(256)], dtype="<u2")
    chars[32] = 32  # between words
    return chars


_BYTE_CHARS = _byte_chars()
_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This Python worker's encoder, kept with its tables from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text, append ``end_id``, and write ``doc_id``, ``at`` (ids before it in its file), ``n_tokens`` and ``ids`` as ORC.

    Documents are dealt by ranges of their id and sorted within, so the files in name order hold ascending ids, a
    stripe covers a narrow range, and a reader of one id skips by minimum, maximum and Bloom filter.  Each document is
    one row: its ids form runs that ORC's integer encoding packs.

    A null text is an empty one and gets the end id alone.  A null id comes first.  Rows that repeat an id stay
    together, in order of text length and hash.  An empty table gives an empty folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, before = word_encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 0
        for rows in batches:
            for at in range(0, rows.num_rows, 512):
                some = rows.slice(at, 512)
                packed = [ids + end for ids in encoder.encode_all(some.column(1).to_pylist())]
                counts = np.array([len(x) // 4 for x in packed], dtype=np.int64)
                ids = np.frombuffer(b"".join(packed), dtype="<i4")
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                at_ = pa.array(before + offsets[:-1].astype(np.int64))
                before += int(counts.sum())
                columns = [some.column(0), at_, pa.array(counts), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    in_order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), F.xxhash64("text"))
    encoded = in_order.mapInArrow(run, _SCHEMA)
    encoded.write.options(**ORC_OPTIONS).orc(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).orc(folder)


def file_starts(tokens: DataFrame) -> DataFrame:
    """``part`` (file name) and ``before``: the ids of all files before it, from one narrow column."""
    per_file = tokens.groupBy(F.col("_metadata.file_name").alias("part")).agg(F.sum("n_tokens").alias("held"))
    files = Window.orderBy(F.regexp_extract("part", r"part-(\d+)", 1).cast("long"), "part")
    return per_file.select("part", (F.sum("held").over(files) - F.col("held")).alias("before"))


def token_digest(tokens: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens (counted), ids_crc32.

    ``start`` is what the files before hold plus what the document's own file holds before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column(0)
            offsets, values = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
            codes = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            sizes = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[1:], sizes, pa.array(codes, pa.int64())], ["doc_id", "at", "part", "n_tokens", "ids_crc32"]
            )

    rows = tokens.select("ids", "doc_id", "at", F.col("_metadata.file_name").alias("part"))
    rows = rows.mapInArrow(run, "doc_id long, at long, part string, n_tokens long, ids_crc32 long")
    start = (F.col("before") + F.col("at")).alias("start")
    return rows.join(file_starts(tokens), "part").select("doc_id", start, "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """The documents with ids from ``low`` to ``high``: the reader drops stripes and row groups by their indexes."""
    return read_tokens(spark, folder).filter(F.col("doc_id").between(low, high))
