"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import text_of

# The learning sample: about so many documents of each label at most, of at most so many characters each.
TRAIN_DOCS = (3000, 1200)  # clean, toxic
TRAIN_CHARS = 20_000
DIM = 1 << 18
SEGMENT = 24
THRESHOLD = 0.7
CACHED = 400_000
SUSPECT = -2.5
MET = 500  # different neighbours of a word that are told apart while learning
CHUNK = 1 << 19
_EDGE = ".,|;:!?\"'()[]{}<>*_-"
_WORD = re.compile(r"\S+")


def core_of(word: str) -> str:
    return word.lower().strip(_EDGE)


def features(core: str) -> list[int]:
    """Hashed features of a word in lower case without marks around it: itself, its beginnings, its ending, its size."""
    names = [f"w:{core}", f"e:{core[-3:]}", f"n:{min(len(core), 12)}"]
    names += [f"{n}:{core[:n]}" for n in (3, 4, 5, 6) if len(core) >= n]
    return [zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM for name in names]


@dataclass
class Crf:
    """Two labels, 0 and 1 (toxic).  ``weights`` score label 1 by a word's features, ``moves`` the step between labels."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float64))
    bias: float = -3.0
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    # Document score: a logistic function of what the marginals add up to.
    doc: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        return self.bias + sum([self.weights.item(f) for f in features(core_of(word))])


def _running(m: list[np.ndarray], order: range, left: bool) -> list[np.ndarray]:
    """Running products of 2x2 matrices, given as their four cells of shape (length, rows), each scaled to sum 1.

    ``left`` multiplies what has been gathered on its left side by the next matrix.
    """
    out = [np.empty_like(x) for x in m]
    now = None
    for t in order:
        a = [x[t] for x in m]
        if now is not None:
            x, y = (a, now) if left else (now, a)
            a = [x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3]]
            total = a[0] + a[1] + a[2] + a[3]
            a = [x / total for x in a]
        now = a
        for cell, value in zip(out, a, strict=True):
            cell[t] = value
    return out


def marginals(crf: Crf, emissions: np.ndarray, firsts: np.ndarray, block: int = 64) -> np.ndarray:
    """The probability of label 1 at every token of documents laid end to end; ``firsts`` marks their first tokens.

    Forward and backward messages are products of 2x2 matrices.  The matrix of a first token has equal rows, so nothing
    passes between documents.  The tokens are cut into blocks whose running products are taken side by side, and the
    messages between blocks follow one after the other: exact, at any length.
    """
    n = len(emissions)
    rows = -(-n // block)
    cells = []
    top = np.maximum(emissions, 0)  # scales each matrix
    for i in range(2):
        for j in range(2):
            move = np.where(firsts, crf.start[j], crf.moves[i, j])
            cell = np.full(rows * block, float(i == j))
            cell[:n] = np.exp(move + (emissions if j else 0) - top)
            cells.append(np.ascontiguousarray(cell.reshape(rows, block).T))
    ahead = _running(cells, range(block), left=False)
    behind = _running(cells, range(block - 1, -1, -1), left=True)
    into, back = np.empty((2, rows)), np.empty((2, rows))
    ends = np.array([x[-1] for x in ahead]).T.tolist()
    a = b = 0.5
    for r, (p, q, u, v) in enumerate(ends):
        into[0, r], into[1, r] = a, b
        a, b = a * p + b * u, a * q + b * v
        a, b = a / (a + b), b / (a + b)
    begins = np.array([x[0] for x in behind]).T.tolist()
    a = b = 0.5
    for r in range(rows - 1, -1, -1):
        back[0, r], back[1, r] = a, b
        p, q, u, v = begins[r]
        a, b = p * a + q * b, u * a + v * b
        a, b = a / (a + b), b / (a + b)
    alpha = [into[0] * ahead[j] + into[1] * ahead[2 + j] for j in range(2)]
    beta = [np.empty((block, rows)) for _ in range(2)]
    for i in range(2):
        beta[i][-1] = back[i]
        beta[i][:-1] = behind[2 * i][1:] * back[0] + behind[2 * i + 1][1:] * back[1]
    one, zero = alpha[1] * beta[1], alpha[0] * beta[0]
    return np.ascontiguousarray((one / (one + zero)).T).reshape(-1)[:n]


def _summary(p: np.ndarray) -> np.ndarray:
    """What a document's score is taken from: 1, the weight of tagged tokens, and its two surest tokens."""
    tagged = p[p >= 0.5]
    top = np.zeros(2)
    best = np.sort(p)[::-1][:2]
    top[: len(best)] = best
    return np.array([1.0, np.log1p(tagged.sum()), *top])


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def token_labels(texts: Sequence[Sequence[str]], toxic: Sequence[int], chance: float = 0.01, odds: float = 12.0) -> list[np.ndarray]:
    """Labels of tokens from labels of documents.

    A token of a toxic document is toxic if its word, or a beginning of it of four letters or more, is met in toxic
    documents far more often than in clean ones: in ``odds`` times as large a share of them, and so often that chance
    would hardly do it for any of the candidates.  For the latter, different pairs of neighbours are counted, because
    copies of one document say nothing new; beyond ``MET`` of them, documents.
    """
    met, toxics, clean = defaultdict(set), defaultdict(int), defaultdict(int)

    def parts(word: str) -> list[str]:
        core = core_of(word)
        return [core + "$", *(core[:n] for n in (4, 5, 6, 7) if len(core) >= n)] if core else []

    for words, label in zip(texts, toxic, strict=True):
        for part in {part for word in set(words) for part in parts(word)}:
            (toxics if label else clean)[part] += 1
        if label:
            for i, word in enumerate(words):
                around = (words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
                for part in parts(word):
                    if len(met[part]) < MET:
                        met[part].add(around)
    tokens = [sum(len(w) for w, y in zip(texts, toxic, strict=True) if y == label) for label in (0, 1)]
    share = min(0.99, max(0.01, tokens[1] / max(1, sum(tokens))))
    bound = np.log(max(1, len(met)) / chance)
    docs = (max(1, len(toxic) - sum(toxic)), max(1, sum(toxic)))

    def stands_out(part: str) -> bool:
        t, c = max(len(met[part]), toxics[part]), clean[part]
        if t < 3 or t <= share * (t + c) or toxics[part] / docs[1] < odds * (c + 0.5) / docs[0]:
            return False
        gain = t * np.log(t / (t + c) / share) + (c * np.log(c / (t + c) / (1 - share)) if c else 0.0)
        return gain >= bound

    chosen = {part for part in met if stands_out(part)}
    return [
        np.array([label and any(part in chosen for part in parts(word)) for word in words], dtype=np.int64)
        for words, label in zip(texts, toxic, strict=True)
    ]


def _segments(texts: Sequence[Sequence[str]], labels: Sequence[np.ndarray], suspects: set[str], rng: np.random.Generator):
    """Stretches of up to ``SEGMENT`` tokens: those with a toxic or a suspect token, and one or two of every document.

    A document's last stretch is as long as what is left, so every token can be learnt from.
    """
    table: dict[str, list[int]] = {}
    feats, marks = [], []
    for words, label in zip(texts, labels, strict=True):
        stretches = -(-len(words) // SEGMENT)
        if not stretches:
            continue
        chosen = {int(x) for x in np.flatnonzero(label) // SEGMENT}
        chosen |= {int(x) for x in rng.integers(0, stretches, 2)}
        if suspects:
            chosen |= {i // SEGMENT for i, word in enumerate(words) if word in suspects}
        for k in sorted(chosen):
            part = slice(k * SEGMENT, (k + 1) * SEGMENT)
            for word in words[part]:
                if word not in table:
                    table[word] = features(core_of(word))
            feats.append([table[word] for word in words[part]])
            marks.append(label[part])
    return feats, marks


def fit(texts: Sequence[str], toxic: Sequence[int], rounds: int = 30, ridge: float = 1e-4, seed: int = 5) -> Crf:
    """A field learnt from whole texts and their labels, by gradient steps on the likelihood of the token labels."""
    crf = Crf()
    if not len(texts) or not any(toxic):
        return crf
    words = [text.split() for text in texts]
    labels = token_labels(words, toxic)
    rng = np.random.default_rng(seed)
    suspects: set[str] = set()
    for _ in range(2):  # the second time with the stretches in which clean words looked toxic
        feats, marks = _segments(words, labels, suspects, rng)
        if not len(feats):
            break
        widest = max(len(f) for segment in feats for f in segment)
        table = np.full((len(feats), SEGMENT, widest), DIM, np.int64)
        known = np.zeros((len(feats), SEGMENT), bool)
        wanted = np.zeros((len(feats), SEGMENT), np.int64)
        for i, segment in enumerate(feats):
            known[i, : len(segment)] = True
            wanted[i, : len(segment)] = marks[i]
            for j, f in enumerate(segment):
                table[i, j, : len(f)] = f
        _climb(crf, table, wanted, known, rounds, ridge)
        clean = {w for text, label in zip(words, toxic, strict=True) if not label for w in text}
        suspects = {w for w in sorted(clean) if crf.emission(w) > SUSPECT}
    emit = {}
    rows = []
    for text in words:
        values = np.array([emit[w] if w in emit else emit.setdefault(w, crf.emission(w)) for w in text])
        firsts = np.zeros(len(text), bool)
        firsts[:1] = True
        rows.append(_summary(marginals(crf, values, firsts) if len(text) else np.zeros(0)))
    rows, want = np.array(rows), np.array(toxic, dtype=float)
    weight = np.where(want > 0, 0.5 / max(1, want.sum()), 0.5 / max(1, (1 - want).sum()))
    crf.doc = np.zeros(rows.shape[1])

    def value(doc: np.ndarray) -> float:
        z = rows @ doc
        return float((weight * (want * z - np.logaddexp(0, z))).sum() - 5e-4 * doc @ doc)

    for _ in range(30):  # Newton steps, halved where they overshoot
        p = _sigmoid(rows @ crf.doc)
        slope = rows.T @ (weight * (want - p)) - 1e-3 * crf.doc
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(rows.shape[1])
        move = np.linalg.solve(curve, slope)
        while np.abs(move).max() > 1e-6 and value(crf.doc + move) < value(crf.doc):
            move = move / 2
        crf.doc = crf.doc + move
    return crf


def _climb(crf: Crf, table: np.ndarray, marks: np.ndarray, known: np.ndarray, rounds: int, ridge: float) -> None:
    """Gradient steps; ``known`` marks the tokens of each stretch, which come first in its row."""
    weights = np.append(crf.weights, 0.0)
    squares = {name: 1e-8 for name in ("weights", "bias", "start", "moves")}
    n, length = marks.shape
    flat = table.reshape(-1)

    def step(name: str, value, slope):
        squares[name] = squares[name] + slope**2
        return value + 0.5 * slope / np.sqrt(squares[name])

    for _ in range(rounds):
        emissions = weights[table].sum(axis=2) + crf.bias
        p, pairs = _expected(crf, emissions, known)
        off = (marks - p) / n
        slope = np.bincount(flat, np.repeat(off.reshape(-1), table.shape[2]), DIM + 1) - ridge * weights
        slope[DIM] = 0
        seen = np.zeros((2, 2))
        np.add.at(seen, (marks[:, :-1][known[:, 1:]], marks[:, 1:][known[:, 1:]]), 1)
        began = np.array([(marks[:, 0] == 0).sum() - (1 - p[:, 0]).sum(), (marks[:, 0] == 1).sum() - p[:, 0].sum()])
        weights = step("weights", weights, slope)
        crf.bias = float(step("bias", np.array(crf.bias), off.sum()))
        crf.start = step("start", crf.start, began / n)
        crf.moves = step("moves", crf.moves, (seen - pairs) / n - ridge * crf.moves)
    crf.weights = weights[:DIM]


def _expected(crf: Crf, emissions: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the known tokens of each segment (0 elsewhere), and the expected number of each move over all."""
    n, length = emissions.shape
    node = np.stack([np.zeros_like(emissions), emissions], axis=2)
    alpha, beta = np.empty((n, length, 2)), np.zeros((n, length, 2))
    alpha[:, 0] = crf.start + node[:, 0]
    for t in range(1, length):
        moved = np.logaddexp(alpha[:, t - 1, :1] + crf.moves[0], alpha[:, t - 1, 1:] + crf.moves[1]) + node[:, t]
        alpha[:, t] = np.where(known[:, t, None], moved, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        after = beta[:, t + 1] + node[:, t + 1]
        moved = np.logaddexp(crf.moves[:, 0] + after[:, :1], crf.moves[:, 1] + after[:, 1:])
        beta[:, t] = np.where(known[:, t + 1, None], moved, 0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.where(known, np.exp(np.minimum(alpha[..., 1] + beta[..., 1] - total[:, None], 0)), 0)
    after = (beta + node)[:, 1:]
    each = alpha[:, :-1, :, None] + crf.moves + after[:, :, None, :] - total[:, None, None, None]
    pairs = np.exp(each[known[:, 1:]]).sum(axis=0)
    return p, pairs


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def learn(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    train_docs: tuple[int, int] = TRAIN_DOCS, train_chars: int = TRAIN_CHARS,
) -> Crf:
    """A field fitted on the driver to a bounded sample of the labelled rows that are not held out.

    About ``train_docs`` documents of each label (clean, toxic) are taken by a hash of their id, of those with at most
    ``train_chars`` characters; equal texts count once.  Without labelled rows of both kinds everything scores near 0.
    """
    known = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    sizes = {row["_toxic"]: row["count"] for row in known.groupBy("_toxic").count().collect()}
    u = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / float(1 << 20)
    bound = F.when(F.col("_toxic") == 1, train_docs[1] / max(1, sizes.get(1, 0))).otherwise(train_docs[0] / max(1, sizes.get(0, 0)))
    chosen = known.filter(u < bound).select(F.col(id_col).alias("_id"), "_toxic")
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"]).select("_id", "_toxic", F.col(text_col).alias("_text"))
    rows = rows.filter(F.length("_text") <= train_chars).collect()
    sample = {}
    for row in sorted(rows, key=lambda r: (r["_id"], r["_text"])):
        sample.setdefault(row["_text"], int(row["_toxic"]))
    return fit(list(sample), list(sample.values()))


def score(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``spans`` (code point offsets of tagged words in a row), ``tagged`` words and
    ``tag``, a hash of the text.

    Whole texts, in one pass without a shuffle; the field goes out as a broadcast variable of a fixed size.  A word's
    score depends on the word alone and is looked up.  Null and empty texts have no words and score as such; repeated
    rows, null ids and other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        emit: dict[str, float] = {}
        cores: dict[str, float] = {}

        def new(word: str) -> float:
            core = core_of(word)
            value = cores.get(core)
            if value is None:
                if len(cores) >= CACHED:
                    cores.clear()
                value = cores[core] = crf.emission(core)
            if len(word) <= 40:
                if len(emit) >= CACHED:
                    emit.clear()
                emit[word] = value
            return value

        def scored(ids: list, tags: list, texts: list[str], counts: list[int], values: list[float]) -> pa.RecordBatch:
            begins = np.cumsum([0, *counts])
            firsts = np.zeros(len(values), bool)
            firsts[begins[:-1][np.array(counts) > 0]] = True
            p = marginals(crf, np.array(values), firsts) if values else np.zeros(0)
            scores, spans, tagged = [], [], []
            for i, text in enumerate(texts):
                own = p[begins[i] : begins[i + 1]]
                scores.append(float(_sigmoid(_summary(own) @ crf.doc)))
                at = np.flatnonzero(own >= 0.5)
                tagged.append(len(at))
                found = []
                if len(at):
                    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                    for k in at.tolist():
                        if found and found[-1]["last"] == k - 1:
                            found[-1].update(end=places[k][1], last=k)
                        else:
                            found.append({"start": places[k][0], "end": places[k][1], "last": k})
                spans.append([{"start": x["start"], "end": x["end"]} for x in found])
            columns = [pa.array(ids, kind), pa.array(scores), pa.array(spans, spans_kind), pa.array(tagged, pa.int64())]
            columns.append(pa.array(tags, pa.int64()))
            return pa.RecordBatch.from_arrays(columns, ["id", "score", "spans", "tagged", "tag"])

        for rows in batches:
            kind = rows.schema.field(0).type
            ids, tags, texts, counts, values = [], [], [], [], []
            for number, tag, text in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(1), strict=True):
                text = text.as_py()
                words = text.split()
                values += [emit[w] if w in emit else new(w) for w in words]
                ids.append(number)
                tags.append(tag)
                texts.append(text)
                counts.append(len(words))
                if len(values) >= CHUNK:
                    yield scored(ids, tags, texts, counts, values)
                    ids, tags, texts, counts, values = [], [], [], [], []
            if ids:
                yield scored(ids, tags, texts, counts, values)

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("tag"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, score double, spans array<struct<start:long,end:long>>, tagged long, tag long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, spans, tagged for every document."""
    rows = score(docs, learn(docs, labels))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return rows.select("doc_id", out, "score", predicted, "spans", "tagged")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores ``threshold`` or more.

    A row is found again by its id and a hash of its text: under an id that repeats, or is null, each text is judged by
    itself, and equal texts fare alike.
    """
    return without(docs, score(docs, learn(docs, labels)).filter(F.col("score") >= threshold))


def without(docs: DataFrame, lost: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have the id and the text of a row of ``lost`` (``id_col`` and ``tag``)."""
    lost = lost.select(F.col(id_col).alias("_lost_id"), F.col("tag").alias("_lost_tag")).distinct()
    same = docs[id_col].eqNullSafe(lost["_lost_id"]) & (F.xxhash64(text_of(text_col)) == lost["_lost_tag"])
    return docs.join(lost, same, "left_anti")
