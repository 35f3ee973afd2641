"""Token counts by a count-only Viterbi pass over a unigram vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import text_of

CACHED = 400_000
# What an unknown character costs below the worst piece; fixed by the tokenizers this follows.
UNKNOWN_PENALTY = 10.0
SPACE = "\u2581"


class UnigramCounter:
    """The number of pieces in the best segmentation of a text, without the pieces.

    An Aho-Corasick automaton gives all vocabulary matches by their ends; per position the best score and its piece
    count are carried on.  Where two ways to a position score the same, the piece that begins first stays; a character
    that is no piece costs the worst score less the penalty, and unknown characters in a row count as one piece.
    A text is cut before each space, which belongs to the word after it, so words are independent and looked up.
    """

    def __init__(self, pieces: Sequence[tuple[str, float]], cached: int = CACHED):
        self.machine = ahocorasick.Automaton()
        self.worst = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        scores = {piece: score for piece, score in pieces if piece}
        for piece, score in scores.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {piece for piece in scores if len(piece) == 1}
        self.words: dict[str, int] = {}
        self.cached = cached

    def word(self, word: str) -> int:
        """Piece count of one word, as it stands."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.machine):
            for end, match in self.machine.iter(word):
                ends[end].append(match)
        best, count, unknown = [0.0] + [None] * n, [0] + [0] * n, [False] * (n + 1)
        for end in range(1, n + 1):
            # Longer pieces begin first and win ties.
            for size, score in sorted(ends[end - 1], reverse=True):
                total = best[end - size] + score
                if best[end] is None or total > best[end]:
                    best[end], count[end], unknown[end] = total, count[end - size] + 1, False
            if word[end - 1] not in self.single:
                total = best[end - 1] + self.worst
                if best[end] is None or total > best[end]:
                    best[end], unknown[end] = total, True
                    count[end] = count[end - 1] + (not unknown[end - 1])
        return count[n]

    def _new(self, word: str) -> int:
        count = self.word(word)
        if len(word) <= 40:
            if len(self.words) >= self.cached:
                self.words.clear()
            self.words[word] = count
        return count

    def count(self, text: str) -> int:
        """Pieces of a text.  Each space stands for the mark before a word; the first word has one in any case."""
        if not text:
            return 0
        known = self.words
        first, *rest = text.replace(" ", SPACE).split(SPACE)
        words = [first, *rest] if first else rest
        return sum([known[w] if w in known else self._new(w) for w in map(SPACE.__add__, words)])


# This Python worker's counter, with the vocabulary it was made from.
_HELD: list = []


def count_tokens(
    docs: DataFrame, pieces: Sequence[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``n_chars`` of every whole text, in one pass without a shuffle.

    The vocabulary (a fixed size) goes out once as a broadcast variable.  A null text is an empty one and has no
    tokens.  Repeated rows come back as often as they came; other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        if not _HELD or _HELD[0] is not pieces:
            _HELD[:] = pieces, UnigramCounter(pieces)
        counter = _HELD[1]
        for rows in batches:
            texts = rows.column(1).to_pylist()
            counts = pa.array([counter.count(text) for text in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), counts, pa.array(list(map(len, texts)), pa.int64())], ["id", "n_tokens", "n_chars"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_chars long").withColumnRenamed("id", id_col)


def zipf_scores(pieces: Sequence[str]) -> list[tuple[str, float]]:
    """Log probabilities by rank, up to a constant: the vocabulary's order is its order of frequency."""
    return [(piece, -math.log(rank + 2)) for rank, piece in enumerate(pieces)]


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]
