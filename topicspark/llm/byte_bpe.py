"""Byte-level BPE by prefix dynamic programming: each byte prefix's one valid last token."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import text_of

CACHED = 150_000
_ADJACENT_SPACE = regex.compile(r"^\s|\s\s|\s$")


class PrefixBpe:
    """Encodes byte pieces by merge ranks.

    For a byte prefix, exactly one token can be the last of the prefix's encoding.  It is the token t, ending there,
    for which the encoding of what comes before ends in a token that t may follow; whether one token may follow another
    does not depend on anything around the two.  ``last[i]`` holds that token for the prefix of i bytes, so the
    encoding of any prefix is read off backwards, appending bytes only adds entries, and an edit leaves the entries
    before it as they are.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.followed: dict[tuple[int, int], bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; None for a single byte."""
        if token in self.halves:
            return self.halves[token]
        text, ranks, found = self.tokens[token], self.ranks, None
        for at in range(1, len(text)):
            left, right = ranks.get(text[:at]), ranks.get(text[at:])
            if left is None or right is None or left >= token or right >= token:
                continue
            if self.stands(left) and self.stands(right) and self._free(left, right, token):
                found = (left, right)
                break
        self.halves[token] = found
        return found

    def stands(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as that token."""
        return len(self.tokens[token]) == 1 or self.split(token) is not None

    def may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.followed.get(key)
        if known is None:
            if len(self.followed) > 1_000_000:
                self.followed.clear()
            known = self.followed[key] = self._free(left, right, None)
        return known

    def _free(self, left: int, right: int, below: int | None) -> bool:
        """Whether no merge crosses the border of two adjacent tokens.

        The merges of both sides are undone from the latest back to the first.  While they are undone, the border lies
        between two parts; had a merge of those two come before the merge undone last, it would have been made.  Ties
        in rank go to the left pair.  With ``below``, only merges of a smaller rank count.
        """
        tokens, ranks = self.tokens, self.ranks
        # Ranks from which on the two parts at the border no longer exist by themselves.
        left_until = right_until = len(ranks) + 1 if below is None else below
        while True:
            crossing = ranks.get(tokens[left] + tokens[right])
            # The left part goes into a merge on its left; at the same rank that one comes first.
            if crossing is not None and crossing < left_until and crossing <= right_until:
                if below is None or crossing < below:
                    return False
            if left >= right:
                halves = self.split(left)
                if halves is not None:
                    left_until, left = min(left, right_until, left_until), halves[1]
                    continue
                halves = self.split(right)
                if halves is None:
                    return True
                right_until, right = min(right, left_until, right_until), halves[0]
            else:
                halves = self.split(right)
                if halves is not None:
                    right_until, right = min(right, left_until, right_until), halves[0]
                    continue
                halves = self.split(left)
                if halves is None:
                    return True
                left_until, left = min(left, right_until, left_until), halves[1]

    @cached_property
    def matches(self) -> ahocorasick.Automaton:
        """Finds all tokens in a text; bytes are written as Latin-1 characters."""
        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            found.add_word(token.decode("latin-1"), (len(token), rank))
        found.make_automaton()
        return found

    def extend(self, text: bytes, last: list[int], upto: int | None = None) -> None:
        """Append the last tokens of all prefixes of ``text`` (up to ``upto`` bytes) longer than those ``last`` covers;
        ``last[0]`` is -1.  Only tokens that occur in the text are tried, each where it ends."""
        done, upto = len(last), len(text) if upto is None else upto
        begin = max(0, done - self.longest)
        last += [-1] * (upto + 1 - done)
        followed, may_follow = self.followed, self.may_follow
        # A position is one less than the length of the prefix that ends there.
        for at, (size, token) in self.matches.iter(text[begin:upto].decode("latin-1")):
            end = begin + at + 1
            if end < done or last[end] >= 0:
                continue
            start = end - size
            if start:
                left = last[start]
                known = followed.get((left, token))
                if known if known is not None else may_follow(left, token):
                    last[end] = token
            elif self.stands(token):
                last[end] = token
        if -1 in last[done:]:
            raise ValueError(f"the ranks lack the byte {text[last.index(-1, done) - 1]:#x}")

    def read_off(self, last: list[int]) -> list[int]:
        """The encoding of the longest prefix in ``last``."""
        ids, at = [], len(last) - 1
        while at > 0:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        last = [-1]
        self.extend(piece, last)
        return self.read_off(last)


class EditedText:
    """A piece that grows at its end or is edited near it, always with its exact encoding."""

    def __init__(self, bpe: PrefixBpe, text: bytes = b""):
        self.bpe, self.text, self.last = bpe, b"", [-1]
        self.append(text)

    def append(self, text: bytes) -> None:
        self.text += text
        self.bpe.extend(self.text, self.last)

    def replace(self, start: int, end: int, text: bytes) -> None:
        """Put ``text`` in place of bytes start to end.

        Entries before ``start`` are used again.  An entry follows from those as far back as the longest token, so
        behind the new bytes, once that many in a row are as they were, all others are.
        """
        old, shift = self.last, start + len(text) - end
        self.text = self.text[:start] + text + self.text[end:]
        self.last = old[: start + 1]
        same, longest = 0, self.bpe.longest
        self.bpe.extend(self.text, self.last, start + len(text))
        while len(self.last) <= len(self.text):
            known = len(self.last)
            self.bpe.extend(self.text, self.last, min(len(self.text), known - 1 + longest))
            for at in range(known, len(self.last)):
                same = same + 1 if at - shift > 0 and self.last[at] == old[at - shift] else 0
                if same == longest:
                    self.last[at + 1 :] = old[at + 1 - shift :]
                    return

    def ids(self) -> list[int]:
        return self.bpe.read_off(self.last)


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    """The encoder of a rank file (lines of base64 token and rank)."""
    with open(path, "rb") as lines:
        return PrefixBpe({base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())})


class TextEncoder:
    """Whole texts: each match of the pattern is encoded by itself, as 4-byte little-endian ids.

    Between two characters that are not white space, a single space opens a match; so where no two white-space
    characters meet, a text is cut at its spaces and equal parts are looked up.  Other texts are matched as a whole.
    A full table becomes the old one, and what is met again moves from there to the new one.
    """

    def __init__(self, bpe: PrefixBpe, pattern: str, cached: int = CACHED):
        self.bpe, self.pattern, self.cached = bpe, regex.compile(pattern), cached
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        packed = self.old_pieces.get(piece)
        if packed is None:
            ids = self.bpe.encode(piece.encode("utf-8"))
            packed = array("I", ids).tobytes()
        if len(piece) <= 40:
            if len(self.pieces) >= self.cached:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = packed
        return packed

    def _matched(self, text: str) -> bytes:
        known = self.pieces
        return b"".join([known.get(p) or self._piece(p) for p in self.pattern.findall(text)])

    def _part(self, part: str) -> bytes:
        packed = self.old_parts.get(part)
        if packed is None:
            packed = self._matched(part)
        if len(part) <= 40:
            if len(self.parts) >= self.cached:
                self.old_parts, self.parts = self.parts, {}
            self.parts[part] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if _ADJACENT_SPACE.search(text):
            return self._matched(text)
        first, *rest = text.split(" ")
        known = self.parts
        return b"".join([self._matched(first), *[known.get(p) or self._part(p) for p in map(" ".__add__, rest)]])


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """This Python worker's encoder, kept with its tables from task to task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(load(path), pattern)
    return _ENCODERS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids`` (4-byte little-endian token ids) and ``decoded`` (the bytes they stand for).

    One row per input row, in one pass without a shuffle.  A null text is an empty one, which has no ids.  Any other
    column, null ids, ties and repeated rows play no part; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        tokens = encoder.bpe.tokens
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                some = rows.slice(at, 256)
                ids = [encoder.encode(text) for text in some.column(1).to_pylist()]
                decoded = [b"".join([tokens[i] for i in memoryview(x).cast("I")]) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(decoded, pa.binary())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)
