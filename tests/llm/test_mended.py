"""Passages in any row order, recall of vectors, stages that keep what they should, short toxic texts, broken records."""

from __future__ import annotations

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, words
from topicspark.llm import byte_bpe, chat_format, passages, simhash, toxicity, vector_dedup
from topicspark.llm.common import read

SF = "/root/testdata/sf0.001"


# Passages


def removed(docs, **options):
    out = passages.remove_repeats(docs, **options)
    return sorted(map(tuple, out.select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256)).collect()))


@pytest.mark.parametrize("options", [{}, {"block_runs": 50, "spans": 2, "group": 2, "block_bytes": 4000}])
def test_passages_in_any_order(spark, options):
    docs = read(spark, SF, "documents")
    want = removed(docs.orderBy("doc_id").coalesce(1))
    for dealt in (docs.orderBy(F.desc("doc_id")).coalesce(1), docs.orderBy(F.rand(3)).coalesce(3), docs.repartition(2)):
        assert removed(dealt, **options) == want


def test_copies_before_their_owner(spark):
    text = words(60, 1)
    rows = spark.createDataFrame([(9, text), (3, text), (5, "more:" + text[:120] + "|end")], "doc_id long, text string").coalesce(1)
    assert {r[0]: r[1] for r in removed(rows)} == {3: 0, 9: len(text), 5: 120}


def test_longest_previous_factors():
    for seed in range(60):
        draw = random.Random(seed)
        length, docs, starts, owners = draw.choice([3, 8, 9, 17]), [], [], []
        at = 0
        for _ in range(draw.randrange(1, 6)):
            doc = bytes(draw.choice(b"ab" if seed % 2 else b"a\0") for _ in range(draw.randrange(60)))
            owner = draw.randrange(4)
            for k in range(len(doc) - length + 1):
                starts.append(at + k)
                owners.append(owner)
            docs.append(doc)
            at += len(doc)
        text = b"".join(docs)
        got = passages.longest_previous_factors(np.frombuffer(text, np.uint8), np.array(starts, int), np.array(owners, int), length)
        suffixes = [text[s : s + length] for s in starts]
        shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
        want = [max([shared(a, b) for b, p in zip(suffixes, owners, strict=True) if p < o], default=0) for a, o in zip(suffixes, owners, strict=True)]
        assert got.tolist() == want


# Byte pairs


def test_edits_find_back_to_the_old_entries():
    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    draw = random.Random(2)
    held = byte_bpe.EditedText(bpe, words(300, 4).encode())
    tried = []
    extend = bpe.extend
    bpe.extend = lambda text, last, upto=None: (tried.append((len(text) if upto is None else upto) + 1 - len(last)), extend(text, last, upto))[1]
    try:
        for _ in range(20):
            a = draw.randrange(len(held.text) - 500)
            put = words(draw.randrange(1, 4), draw.randrange(100)).encode()
            want = held.text[:a] + put + held.text[a + 3 :]
            tried.clear()
            held.replace(a, a + 3, put)
            assert held.text == want and sum(tried) < len(put) + 400
            bpe.extend, spy = extend, bpe.extend
            assert held.ids() == bpe.encode(want)
            bpe.extend = spy
    finally:
        del bpe.extend


# Vectors


def vectors(kind: str, n: int = 5000, dim: int = 48, pairs: int = 1000):
    draw = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, along = unit(draw.standard_normal((n, dim))), unit(draw.standard_normal((1, dim)))
    if kind == "dense":
        return unit(unit(draw.standard_normal((60, dim)))[draw.integers(0, 60, n)] + 0.28 * x).astype(np.float32)
    if kind == "cone":
        x = np.sqrt(0.8) * along + np.sqrt(0.2) * unit(x - (x @ along.T) * along)
    y, u = draw.standard_normal((pairs, dim)), x[:pairs]
    y = unit(y - (y * u).sum(axis=1, keepdims=True) * u)
    return np.vstack([x, 0.935 * u + np.sqrt(1 - 0.935**2) * y]).astype(np.float32)


@pytest.mark.parametrize("kind", ["even", "cone", "dense"])
def test_recall_of_vectors(spark, kind):
    x = vectors(kind)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.93
    np.fill_diagonal(close, False)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": np.zeros(len(x), np.int32)})
    frame = spark.createDataFrame(table).withColumn("mean", F.lit(1)).withColumn("rep", F.lit("x")).repartition(4)
    found = np.array([r["n_links"] for r in vector_dedup.near_vectors(frame).orderBy("vec_id").collect()])
    assert (found <= close.sum(axis=1)).all()
    assert found.sum() >= 0.95 * close.sum() > 0


# Stages


def documents_of(spark, rows):
    full = [(i, t, "en", "a", 0, 1, "l", "b", "f", "r", 2, 0.5, "k", "p") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(2)


def kept(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_near_stage_judges_each_text_of_an_id(spark):
    copy, own = words(40, 1), words(40, 2)
    rows = [(1, copy), (5, copy), (5, own), (None, copy), (None, words(40, 3)), (7, words(40, 4)), (7, words(40, 4))]
    want = sorted([(1, copy), (5, own), (None, words(40, 3)), (7, words(40, 4)), (7, words(40, 4))], key=repr)
    assert kept(simhash.keep_one_of_each(documents_of(spark, rows))) == want
    assert kept(corpus_pipeline.near(spark, documents_of(spark, rows), SF)) == want


def test_toxic_stage_judges_each_text_of_an_id(spark, monkeypatch):
    crf = toxicity.Crf()
    for feature in toxicity.features("vile"):
        crf.weights[feature] = 3.0
    crf.doc = np.array([-5.0, 0.0, 10.0, 0.0])
    monkeypatch.setattr(toxicity, "learn", lambda docs, labels: crf)
    rows = [(1, "a vile thing"), (1, "a good thing"), (None, "so vile"), (None, "so good"), (2, None), (3, "")]
    want = sorted([(1, "a good thing"), (None, "so good"), (2, None), (3, "")], key=repr)
    assert kept(toxicity.keep_clean(documents_of(spark, rows), None)) == want


def test_exact_stage_keeps_one_of_equal_texts(spark):
    rows = [(4, "a b"), (2, "ab"), (2, "other"), (9, "a b "), (None, "ab"), (None, "z")]
    assert kept(corpus_pipeline.exact(spark, documents_of(spark, rows), SF)) == sorted([(9, "a b "), (2, "other"), (None, "z")], key=repr)


# Toxicity


def test_short_texts_are_learnt():
    draw = random.Random(3)
    pool = ["".join(draw.choice("abcdefghijk") for _ in range(5)) for _ in range(400)]
    texts, toxic = [], []
    for i in range(900):
        some = [draw.choice(pool) for _ in range(10)]
        if i % 3 == 0:
            some[draw.randrange(10)] = draw.choice(["zorgle", "vexmuk"])
        texts.append(" ".join(some))
        toxic.append(int(i % 3 == 0))
    crf = toxicity.fit(texts[:600], toxic[:600])

    def score(text):
        values = np.array([crf.emission(w) for w in text.split()])
        return toxicity._sigmoid(toxicity._summary(toxicity.marginals(crf, values, np.arange(len(values)) == 0)) @ crf.doc)

    assert all((score(t) >= toxicity.THRESHOLD) == bool(y) for t, y in zip(texts[600:], toxic[600:], strict=True))


def test_masked_marginals_are_those_of_the_bare_segment():
    draw = np.random.default_rng(4)
    crf = toxicity.Crf(start=draw.standard_normal(2), moves=draw.standard_normal((2, 2)))
    emissions = draw.standard_normal((3, 6))
    for n in (1, 2, 5, 6):
        known = np.arange(6)[None, :].repeat(3, axis=0) < n
        p, pairs = toxicity._expected(crf, emissions, known)
        q, bare = toxicity._expected(crf, emissions[:, :n], np.ones((3, n), bool))
        assert np.allclose(p[:, :n], q) and not p[:, n:].any() and np.allclose(pairs, bare)


# Chat


@pytest.mark.parametrize(
    "record",
    [
        '{"messages":[{"role":"user","content":"x"},{"role":"assistant"}]}',
        '{"messages":[{"role":"user","content":"x"},{}]}',
        '{"messages":[{"role":"user","content":"x"},"y"]}',
        '{"prompt":"\\ud800","response":"y"}',
        '{"messages":[{"role":"user","content":"\\udfff"}]}',
        "[" * 3000 + "]" * 3000,
        "[" * 200_000,
        '{"prompt":',
    ],
)
def test_broken_records_are_unknown(spark, record):
    frame = spark.createDataFrame([(1, record), (2, json.dumps({"prompt": "a", "response": "b"}))], "id long, record string")
    rows = {r["id"]: r for r in chat_format.format_records(frame).collect()}
    assert (rows[1]["known"], rows[1]["formatted"], rows[1]["mask"]) == (False, "", [])
    assert rows[2]["known"] and chat_format.parse(rows[2]["formatted"]) == [("user", "a"), ("assistant", "b")]
