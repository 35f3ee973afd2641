"""Lines, source divergence and spelling forms against plain versions, with nulls, copies, ties and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from topicspark.llm import divergence, line_dedup, spelling

SCHEMA = "doc_id long, text string, lang string, source string, a long, code string, kept string, bits string"


def frame(spark, rows, parts=3):
    full = [(i, t, lang, source, 1, "x", "y", "z") for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


# Lines


def plain_lines(rows, least=20, enough=3):
    split = [(-(1 << 63) if i is None else i, (t or "").split("\n")) for i, t, *_ in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    owners = defaultdict(set)
    for doc, lines in split:
        for line in lines:
            if len(key(line)) >= least:
                owners[key(line)].add(doc)
    out = []
    for (i, *_), (doc, lines) in zip(rows, split, strict=True):
        left = [x for x in lines if len(owners.get(key(x), ())) < enough or doc == max(owners[key(x)])]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def line_rows():
    draw = random.Random(3)
    shared = [words(6, i) for i in range(12)] + ["é" * 19, "é" * 20, "x" * 19, "X" * 20, "  " + "x" * 20 + "\r"]
    rows = []
    for i in range(60):
        lines = [draw.choice(shared) if draw.random() < 0.7 else words(5, 1000 + draw.randrange(10_000)) for _ in range(draw.randrange(12))]
        rows.append((i, "\n".join(lines), "en", "s"))
    hot = words(7, 77)
    rows += [(100 + i, f"{hot}\n{hot.upper()}\nown {i} " + words(6, 5000 + i), "en", "s") for i in range(80)]
    rows += [(None, None, None, None), (None, hot, "en", "s"), (None, "\n" + hot, "en", "s"), (7, hot, "en", "t"), (7, hot, "en", "t")]
    rows += [(500, "\n".join([hot] * 300), "en", "s"), (501, "", "en", "s"), (502, "\n\n", "en", "s"), (503, hot + "\n" + words(30_000, 8), "en", "s")]
    return rows


@pytest.mark.parametrize("block", [1, 40, 1 << 19])
@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_lines_against_plain_version(spark, block, order):
    rows = line_rows()
    dealt = {"up": rows, "down": rows[::-1], "mixed": random.Random(1).sample(rows, len(rows))}[order]
    found = line_dedup.drop_repeated_lines(frame(spark, dealt), block_lines=block).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_lines(rows)


def test_lines_of_nothing(spark):
    out = line_dedup.drop_repeated_lines(frame(spark, []))
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept"] and out.count() == 0


def test_two_holders_keep_their_lines_and_three_do_not(spark):
    line = "a line of twenty or more"
    two = line_dedup.drop_repeated_lines(frame(spark, [(1, line, "", ""), (2, line, "", "")])).collect()
    assert {r["n_dropped"] for r in two} == {0}
    three = line_dedup.drop_repeated_lines(frame(spark, [(i, line, "", "") for i in (1, 2, 3)])).collect()
    assert {r["doc_id"]: r["kept"] for r in three} == {1: "", 2: "", 3: line}


def test_bitmaps_are_smaller_than_lists(spark):
    keep = line_dedup.kept_lines(zlib.compress(bytes([0b10100000])), 11).tolist()
    assert keep == [True, False, True] + [False] * 5 + [True] * 3


# Divergence


def plain_divergence(rows, least, top=10):
    docs = [(lang or "", source or "", divergence.terms_of((t or "").encode())) for _, t, lang, source in rows]
    within, total = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        within[lang].update(set(terms))
        total[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in within[lang].items() if n >= least)
        sources = sorted(s for g, s in total if g == lang)

        def priced(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        whole = priced(sum((total[lang, s] for s in sources), Counter()))
        each = {s: priced(total[lang, s]) for s in sources}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(gap(each[s][t], each[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(each[s][t], whole[t]), t) for t in kept if total[lang, s][t] and each[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode() if isinstance(x[1], str) else x[1]))[:most]
                out += [(lang, s, part, i if isinstance(i, str) else i.decode(), v, k) for k, (v, i) in enumerate(ranked, 1)]
    return sorted(out)


def divergence_rows():
    draw = random.Random(5)
    vocabulary = [words(1, i) for i in range(70)] + ["Été", "été", "一二", "\U0001f642x", "\u0080"]
    rows = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else f"s{draw.randrange(11)}"
        text = " ".join(draw.choice(vocabulary).upper() if draw.random() < 0.2 else draw.choice(vocabulary) for _ in range(draw.randrange(30)))
        rows.append((i % 290, text + "[1_9`{", draw.choice(["en", "fr", None]), source))
    rows += [(900, None, "en", "silent"), (901, "rare", "de", "a"), (902, "other", "de", "b"), (903, "", "", None), (904, "", None, "q")]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize(("slice_terms", "task_sources", "held"), [(1 << 15, 8, 400_000), (7, 2, 5), (1, 1, 1)])
def test_divergence_against_plain_version(spark, slice_terms, task_sources, held):
    rows = divergence_rows()
    found = divergence.source_divergence(frame(spark, rows), slice_terms=slice_terms, task_sources=task_sources, held=held)
    assert sorted(tuple(r) for r in found.collect()) == plain_divergence(rows, 10)


def test_divergence_counts_a_document_of_several_rows_once(spark):
    texts = ["both rare", "both twice twice", "both more"]
    rows = [(1, "once both", "en", "a"), (1, "once", "en", "b"), (2, "both", "en", "b"), (2, "both", "en", "b")]
    rows += [(i, texts[i % 3], "en", "ab"[i % 2]) for i in range(3, 9)]
    rows += [(3, "once", "fr", "a"), (4, "once", "fr", "a"), (None, "none", "en", "a"), (None, "none", "en", "b")]
    found = divergence.source_divergence(frame(spark, rows), least=2, document="doc_id")
    # As if no text beyond the first of a document held the words, but for their number.
    kept = {"en": ["both", "more", "rare", "twice"], "fr": ["once"]}
    assert {(r["lang"], r["item"]) for r in found.filter("part = 'term'").collect()} <= {(g, t) for g in kept for t in kept[g]}
    n = {s: Counter(w for _, t, g, o in rows if g == "en" and o == s for w in t.split() if w in kept["en"]) for s in "ab"}
    p = {s: {t: 1 + 10**9 * (n[s][t] + 2) // (sum(n[s].values()) + 8) for t in kept["en"]} for s in "ab"}
    gap = sum((p["a"][t] - p["b"][t]) ** 2 // (p["a"][t] + p["b"][t]) for t in kept["en"])
    assert {r["value"] for r in found.filter("part = 'pair'").collect()} == {gap}


def test_a_pair_has_one_name_in_every_slice():
    import pyarrow as pa

    cells = pa.array([[{"id": 1, "n": 3}], [{"id": 2, "n": 5}]], pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())])))
    rows = pa.table({"source": ["x", "y"], "block": [0, 0], "total": [3, 5], "vocabulary": [2, 2], "terms": [2, 2], "cells": cells})
    keys = tuple(pa.scalar(k) for k in ("en", 0, 0, 0))
    assert divergence._pair_task(keys, rows).equals(divergence._pair_task(keys, rows.take([1, 0])))


def test_a_counting_task_holds_no_more_than_it_may():
    import pyarrow as pa

    texts = [" ".join(f"{words(1, i)} {words(1, i)} {words(1, i + 1)}" for _ in range(2)).encode() for i in range(40)]
    names = ["lang", "source", "text"]
    rows = pa.RecordBatch.from_arrays([pa.array(["en"] * 40), pa.array(["a", "b"] * 20), pa.array(texts)], names)
    sent = list(divergence._count(6)(iter([rows])))
    # One text goes over what is held by two terms and its group at most, however many texts a batch has.
    assert len(sent) > 10 and max(b.num_rows for b in sent) <= 6 + 3
    sums = defaultdict(lambda: [0, 0])
    for r in (r for b in sent for r in b.to_pylist()):
        sums[r["source"], r["term"]][0] += r["n"]
        sums[r["source"], r["term"]][1] += r["docs"]
    plain = defaultdict(lambda: [0, 0])
    for i, text in enumerate(texts):
        plain["ab"[i % 2], None][1] += 1
        for term, n in Counter(divergence.terms_of(text)).items():
            plain["ab"[i % 2], term.decode()][0] += n
            plain["ab"[i % 2], term.decode()][1] += 1
    assert sums == plain


def test_divergence_of_nothing(spark):
    out = divergence.source_divergence(frame(spark, []))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_prices_are_exact_for_large_totals():
    import numpy as np

    counts = np.array([0, 1, 10**12, 10**15 + 7])
    over, v = 4 * 10**15 + 13, 10**6
    assert divergence.prices(counts, over, v).tolist() == [1 + 10**9 * (c + 2) // (over + 2 * v) for c in counts.tolist()]


# Spelling


def plain_forms(rows):
    import re

    counts = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def spelling_rows():
    draw = random.Random(11)
    base = ["letter", "lettre", "étérnel", "straße", "a" * 70, "b" * 300 + "c", "abcdefghij", "aaaaab", "×÷×÷×"]
    pool = list(base)
    for w in base * 6:
        at = draw.randrange(len(w))
        pool.append(draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("abzéÿ") + w[at:], w[:at] + "q" + w[at + 1 :], w[::-1]]))
    rows = []
    for i in range(400):
        text = draw.choice([" ", "1", "一", "\n"]).join(draw.choice(pool) for _ in range(draw.randrange(25)))
        rows.append((i, text.upper() if i % 50 == 0 else text, "en", "s"))
    chain = ["chainaa", "chainab", "chainbb", "chaicbb", "chbicbb"]
    rows += [(1000 + i, " ".join(w for k, w in enumerate(chain) for _ in range(3 << k)), "en", "s") for i in range(1)]
    return rows + [(None, "letter letter letter", None, None), (5, None, "", ""), (6, "", "", ""), rows[3], rows[3]]


@pytest.mark.parametrize("group", [4096, 3, 1])
def test_forms_against_plain_version(spark, group):
    rows = spelling_rows()
    found = spelling.spelling_forms(frame(spark, rows), group=group).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_forms(rows)


def test_forms_of_nothing(spark):
    out = spelling.spelling_forms(frame(spark, [(1, None, "", ""), (2, "one two", "", "")]))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
    assert spelling.spelling_forms(frame(spark, [])).count() == 0


def test_one_edit():
    assert spelling.one_edit(b"abc", b"abd") and spelling.one_edit(b"abc", b"abcd") and spelling.one_edit(b"bc", b"abc")
    assert not spelling.one_edit(b"abc", b"abc") and not spelling.one_edit(b"abc", b"acb") and not spelling.one_edit(b"a", b"abc")


def test_query_digest(spark):
    rows = line_dedup.drop_repeated_lines(frame(spark, line_rows())).select(F.sha2(F.col("kept").cast("binary"), 256).alias("d"), "kept")
    assert all(r["d"] == hashlib.sha256(r["kept"].encode()).hexdigest() for r in rows.collect())
