"""Each operator against a plain version, on whole test tables and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from topicspark.llm import (
    byte_bpe,
    chat_format,
    components,
    exact_dedup,
    mixing,
    passages,
    patricia,
    simhash,
    token_files,
    toxicity,
    unigram_counts,
    vector_dedup,
)
from topicspark.llm.common import new_folder

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(frame):
    return [(row["doc_id"], row["text"] or "") for row in frame.select("doc_id", "text").collect()]


# -- exact duplicates


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text)


@pytest.mark.parametrize("limit", [exact_dedup.TRIE_BYTES, 300])
def test_owners(spark, edges, limit):
    for frame in (documents(spark), edges):
        rows = pairs(frame)
        groups = defaultdict(list)
        for number, text in rows:
            groups[squeezed(text)].append((-len(text), number is None, number or 0))
        want = Counter()
        for number, text in rows:
            _, none, best = min(groups[squeezed(text)])
            keep = None if none else best
            digest = hashlib.sha256(squeezed(text).encode()).hexdigest()
            want[number, keep, len(groups[squeezed(text)]), number == keep, digest] += 1
        assert Counter(tuple(r) for r in exact_dedup.exact_owners(frame, trie_bytes=limit).collect()) == want


def test_exact_copies_go(edges, nothing):
    kept = exact_dedup.drop_exact_copies(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 6, 7, 8, 9, 10, 11, 11, 12, 13, 14]
    assert exact_dedup.drop_exact_copies(nothing).count() == 0


def test_patricia_cuts_edges_and_subtrees():
    trie = patricia.Patricia()
    keys = [b"", b"abc", b"abd", b"ab", b"xyz", b"x", b"abcdef", b"\x00"]
    for i, key in enumerate(keys):
        trie.node(key).owner = i
    assert [trie.node(key).owner for key in keys] == list(range(len(keys)))
    cut = dict(trie.cut_largest())
    assert cut == {k: i for i, k in enumerate(keys) if k.startswith(b"a")}
    assert [k for k, _ in trie.drain()] == [b"", b"\x00", b"x", b"xyz"]


# -- mixing


def test_mix_report(edges, nothing, spark):
    rows = mixing.mix_report(edges).collect()
    again = mixing.mix_report(edges.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    sizes = defaultdict(int)
    for number, text in pairs(edges):
        assert any(r["doc_id"] == number and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text)) for r in rows)
    for row in rows:
        sizes[row["source"]] += row["size"]
        assert 0 <= row["taken"] <= 2 * row["size"]
    assert all(row["source_size"] == sizes[row["source"]] for row in rows)
    targets = {row["source"]: row["target"] for row in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mixing.mix_report(nothing).count() == 0


def test_mix_takes_what_the_report_says(edges):
    wanted = sum(row["copies"] for row in mixing.mix_report(edges).collect())
    mixed = mixing.mix(edges)
    assert mixed.columns == edges.columns
    assert mixed.count() == wanted


def test_targets_stop_at_twice_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), (None, 500)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # Weights 3, 1, 2, 3: the small sources stop at 20 and 40; the rest is shared 1 to 3, and the last stops at 1000.
    assert got == {"a": 20.0, "c": 40.0, None: 1000.0, "b": 2295.0 - 1060.0}


def test_mix_is_near_its_targets(spark):
    rows = [(i, "w " * (1 + (i * 7919) % 50), f"s{i % 3}") for i in range(3000)]
    report = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in {r["source"] for r in report}:
        own = [r for r in report if r["source"] == source]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=25)


# -- SimHash


def plain_fingerprint(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or [" ".join(parts)]
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_groups(spark, edges, nothing):
    for frame in (documents(spark), edges.filter("doc_id is not null")):
        codes = {number: plain_fingerprint(text) for number, text in pairs(frame)}
        links = [(a, b) for a, b in itertools.combinations(codes, 2) if (codes[a] ^ codes[b]).bit_count() <= 2]
        root = roots(codes, links)
        got = simhash.near_groups(frame).collect()
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
            n: (f"{codes[n]:016x}", root[n]) for n in codes
        }
        assert len(got) == frame.count()
    assert simhash.near_groups(edges).count() == edges.count()
    assert simhash.near_groups(nothing).count() == 0
    assert simhash.keep_one_of_each(edges).columns == edges.columns


def test_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_links_join_all_within_two_bits(spark):
    draw = random.Random(4)
    base = [draw.getrandbits(64) for _ in range(5)]
    codes = {b ^ sum(1 << x for x in draw.sample(range(64), draw.randint(0, 5))) for b in base for _ in range(40)}
    near = [(a, b) for a, b in itertools.combinations(sorted(codes), 2) if (a ^ b).bit_count() <= 2]
    frame = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    found = {(r["fp"] % (1 << 64), r["least"] % (1 << 64)) for r in simhash._links(frame).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    assert roots(codes, near) == roots(codes, found)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    draw = random.Random(1)
    draw.shuffle(links)
    got = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# -- token files


def test_token_files(spark, edges, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for frame in (documents(spark), edges):
        folder = new_folder(spark, "test-orc")
        token_files.write_tokens(frame, folder, path, end_id=2)
        tokens = token_files.read_tokens(spark, folder)
        got = sorted(map(tuple, token_files.token_digest(tokens).collect()), key=lambda r: r[1])
        assert [r[0] is not None and r[0] for r in got] == sorted(
            (n is not None and n for n, _ in pairs(frame)), key=lambda n: -1 if n is False else n
        )
        start, want = 0, Counter()
        for number, text in pairs(frame):
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
            want[number, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        for _, at, n, _ in got:
            assert at == start
            start += n
        assert Counter((r[0], r[2], r[3]) for r in got) == want
        assert {r["doc_id"] for r in token_files.read_documents(spark, folder, 5, 8).collect()} == {5, 6, 7, 8}
    folder = new_folder(spark, "test-orc")
    token_files.write_tokens(nothing, folder, path, end_id=2)
    assert token_files.token_digest(token_files.read_tokens(spark, folder)).count() == 0


def test_word_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), token_files.WordEncoder(path, cached=50)
    draw = random.Random(2)
    pool = ["a", "b", "The", "É", "é", "ß", " ", "\n", "!!", "一", "🙂", "1", "ing", "\t", "'s", "'S", "Σ", "İ", "\x1c", "\x85", "\xa0",
            "<|endoftext|>", "<|start", "oftext|>", ".", ",", "ǅ", "ﬁ", "한", "ª", "\u0000"]
    for _ in range(4000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 9)))
        got = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_new_words_go_to_the_library_together(monkeypatch):
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, inner):
            self.inner, self.calls = inner, 0

        def encode(self, *args, **options):
            self.calls += 1
            return self.inner.encode(*args, **options)

        def encode_batch_fast(self, *args, **options):
            self.calls += 1
            return self.inner.encode_batch_fast(*args, **options)

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), token_files.WordEncoder(path, cached=500)
    encoder.tokenizer, encoder.speller = Counted(encoder.tokenizer), Counted(encoder.speller)
    draw = random.Random(5)
    pool = ["un", "ER", "ing", "é", "ß", "Σ", "İ", "e\u0301", "ǅ", "한", "一", "'s", "'", "7", "_", "-"]
    ends = ["", "", "", ".", ",", "!?", '"', "***", "')", "_", "'", "…"]
    word = lambda: "".join(draw.choice(pool[:5] if draw.random() < 0.9 else pool) for _ in range(draw.randint(1, 9)))
    texts = [" ".join(word() + draw.choice(ends) for _ in range(40)) for _ in range(200)]
    texts += ["", " ", "." * 100, "a" * 300 + "." * 300, "x\x1cy", "... ... ."]
    monkeypatch.setattr(token_files, "TOGETHER", 20_000)
    groups = len([*token_files._together(texts)])
    assert 1 < groups < 20
    got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_all(texts)]
    assert got == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    # One call for letters and one for the rest per group, one per sort of ending marks and per text cut elsewhere.
    marks = {word[len(word.rstrip(string.punctuation)) :] for text in texts for word in text.split()}
    assert encoder.speller.calls <= groups and encoder.tokenizer.calls <= groups + len(marks) + 1
    assert groups + len(marks) < 60
    assert max(map(len, [*encoder.words, *encoder.ends])) <= token_files.LONG
    before = encoder.speller.calls + encoder.tokenizer.calls
    encoder.encode_all(["the new words " * 50])
    assert len(encoder.words) < 500 and encoder.speller.calls + encoder.tokenizer.calls <= before + 2


# -- repeated passages


def plain_removal(rows, length=50):
    first = {}
    for number, text in rows:
        number = 1 << 63 if number is None else number
        for at in range(len(text) - length + 1):
            window = text[at : at + length]
            first[window] = min(number, first.get(window, number))
    for number, text in rows:
        mine, gone = (1 << 63 if number is None else number), bytearray(len(text))
        for at in range(len(text) - length + 1):
            if first[text[at : at + length]] < mine:
                gone[at : at + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield number, len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone, strict=True) if not g)


@pytest.mark.parametrize("options", [{}, {"block_runs": 50, "block_bytes": 300, "spans": 2, "group": 3}])
def test_passages(spark, edges, nothing, options):
    shared = "".join(random.Random(8).choice("abc ") for _ in range(300))
    close = [(i, "x" * (i % 5) + shared[i % 7 : 200 + i] + f" {i} " + shared[:60]) for i in range(40)]
    close = spark.createDataFrame(close, "doc_id long, text string").repartition(4)
    for frame in (documents(spark), edges, close):
        want = Counter(plain_removal([(n, t.encode()) for n, t in pairs(frame)]))
        got = passages.remove_repeats(frame, **options).collect()
        assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == want
    assert passages.remove_repeats(nothing, **options).count() == 0


# -- vectors


def vectors(spark):
    draw = np.random.default_rng(3)
    rows, base = [], draw.normal(size=(30, 16))
    for i in range(400):
        v = base[i % 30] + draw.normal(size=16) * (0.05 if i % 2 else 0.3)
        rows.append((i, v.tolist(), i % 3))
    rows += [(1000 + i, rows[0][1], 0) for i in range(20)] + [(2000 + i, (np.array(rows[0][1]) * 3).tolist(), 0) for i in range(3)]
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 16, 0), (3003, [float("nan")] * 16, 0), (3004, rows[0][1], None),
             (3005, [None] * 16, 0), (3006, [float("inf")] * 16, 0), (3007, rows[0][1][:8], 0), (None, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("block", [1024, 4])
def test_near_vectors(spark, block):
    frame = vectors(spark)
    rows = [r for r in frame.collect() if r["vec_id"] is not None]
    fine = [r for r in rows if r["label"] is not None and r["embedding"] and all(x is not None for x in r["embedding"])]
    fine = [r for r in fine if np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    links = []
    for a, b in itertools.combinations(fine, 2):
        if a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]):
            x, y = np.array(a["embedding"]), np.array(b["embedding"])
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((a["vec_id"], b["vec_id"]))
    degree = Counter(itertools.chain.from_iterable(links))
    root = roots([r["vec_id"] for r in rows], links)
    got = vector_dedup.near_vectors(frame, block=block).collect()
    assert len(got) == frame.count()
    for r in got:
        if r["vec_id"] is not None:
            assert tuple(r) == (r["vec_id"], degree[r["vec_id"]], root[r["vec_id"]], r["vec_id"] == root[r["vec_id"]])
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0


# -- byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load(RANKS).ranks, special_tokens={}
    )


def test_prefix_bpe_is_tiktoken(tiktoken_encoding):
    draw = random.Random(5)
    encoder = byte_bpe.TextEncoder(byte_bpe.load(RANKS), public_tokenizers.PATTERN, cached=40)
    pool = ["a", "b", "the", "é", "ß", " ", "\n", "!!", "====", "一", "🙂", "1", "ing", "\t", "'s", "aaaa"]
    for _ in range(4000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 14)))
        assert list(memoryview(encoder.encode(text)).cast("I")) == tiktoken_encoding.encode_ordinary(text)
    for size in (1, 50, 3000):
        piece = bytes(draw.randrange(256) for _ in range(size))
        assert encoder.bpe.encode(piece) == tiktoken_encoding._encode_single_piece(piece)


def test_prefix_bpe_small_vocabularies_against_merging():
    draw = random.Random(6)

    def merged(ranks, piece):
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(60):
        tokens = [b"a", b"b", b"c"]
        while len(tokens) < 18:
            joined = draw.choice(tokens) + draw.choice(tokens)
            ranks = {t: i for i, t in enumerate(tokens)}
            if joined not in ranks and len(merged(ranks, joined)) == 2:
                tokens.append(joined)
        ranks = {t: i for i, t in enumerate(tokens)}
        bpe = byte_bpe.PrefixBpe(ranks)
        for _ in range(60):
            piece = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 24)))
            assert bpe.encode(piece) == merged(ranks, piece), (tokens, piece)


def test_edited_text(tiktoken_encoding):
    text = byte_bpe.EditedText(byte_bpe.load(RANKS), b"hello wor")
    text.append(b"ld again")
    text.replace(3, 5, b"p me")
    assert text.text == b"help me world again"
    assert text.ids() == tiktoken_encoding._encode_single_piece(text.text)


def test_encode_texts(spark, edges, nothing, tiktoken_encoding):
    for frame in (documents(spark), edges):
        got = byte_bpe.encode_texts(frame, RANKS, public_tokenizers.PATTERN).collect()
        want = Counter()
        for number, text in pairs(frame):
            ids = tiktoken_encoding.encode_ordinary(text)
            want[number, len(ids), np.array(ids, "<u4").tobytes(), text.encode()] += 1
        assert Counter((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in got) == want
    assert byte_bpe.encode_texts(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


# -- chat


def test_templates_are_reversible():
    draw = random.Random(7)
    pool = ["</s>", "[INST]", " ok ", "[/INST]", "\\", "\n", "<|end|>", "<|turn|>", "<", "|", "é", "\\\\"]
    for _ in range(3000):
        turns = [
            (draw.choice(["user", "assistant", "a\nb", "\\", "", "<|turn|>x"]), "".join(draw.choices(pool, k=draw.randint(0, 6))))
            for _ in range(draw.randint(0, 4))
        ]
        formatted, spans = chat_format.render(turns)
        assert chat_format.parse(formatted) == turns
        assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    rows = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}'),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        (3, '{"response": "a", "prompt": "q"}'), (4, '{"instruction": "s", "input": "q", "output": null}'),
        (5, '{"dialog": {"question": "q", "answer": "a"}, "meta": {"system": "s"}}'), (6, '{"messages": []}'),
        (7, '{"other": 1}'), (8, "no json"), (9, None), (10, "[1, 2]"),
    ]
    got = {r["id"]: r for r in chat_format.format_records(spark.createDataFrame(rows, "id long, record string")).collect()}
    asked = [("user", "q"), ("assistant", "a")]
    assert [chat_format.parse(got[i]["formatted"]) for i in (1, 2, 3)] == [asked] * 3
    assert chat_format.parse(got[4]["formatted"]) == [("system", "s"), ("user", "q"), ("assistant", "")]
    assert chat_format.parse(got[5]["formatted"]) == [("system", "s"), *asked]
    assert [got[i]["known"] for i in range(6, 11)] == [True, False, False, False, False]
    assert all(got[i]["formatted"] == "" for i in range(6, 11))


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, "system", None), (2, 1, "user", "q"), (2, 2, "assistant", "a\n"),
        (3, 0, None, "x"), (3, 0, None, "x"), (3, None, "human", "\\"), (None, 0, "user", "lost"), (5, 1, "user", ""), (6, 0, "gpt", "b"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.digest(chat_format.format_records(chat_format.conversation_records(frame))).collect()
    want = defaultdict(list)
    for number, turn, role, text in rows:
        want[number].append((turn is not None, turn or 0, role or "", text or ""))
    assert len(got) == len(want)
    for row in got:
        turns = sorted(want[row["conv_id"]])
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        assert tuple(row)[1:5] == (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        )
    assert chat_format.conversation_records(frame.limit(0)).count() == 0


# -- token counts


def test_unigram_counts(spark, edges, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [p for p, _ in unigram_counts.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))]
    scored = unigram_counts.zipf_scores(pieces)
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *scored], unk_id=0))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = unigram_counts.UnigramCounter(scored, cached=30)
    draw = random.Random(3)
    pool = ["a", "b", "The", "é", "ß", " ", "\n", "!!", "一", "🙂", "1", "ing", "tion", "'s", "  ", "the", "ₓ", "𝔘", "\t", "▁"]
    for _ in range(4000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 9)))
        assert counter.count(text) == len(tokenizer.encode(text).ids), repr(text)
    for frame in (documents(spark), edges):
        got = unigram_counts.count_tokens(frame, scored).collect()
        want = Counter((n, len(tokenizer.encode(t).ids), len(t)) for n, t in pairs(frame))
        assert Counter(map(tuple, got)) == want
    assert unigram_counts.count_tokens(nothing, scored).count() == 0


def test_unigram_ties():
    from tokenizers import Tokenizer, models

    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bb", -2.0)]
    tokenizer, counter = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0)), unigram_counts.UnigramCounter(pieces)
    for word in map("".join, itertools.product("abx", repeat=6)):
        assert counter.word(word) == len(tokenizer.encode(word).ids), word


# -- toxicity


def test_marginals_against_all_paths():
    draw = np.random.default_rng(0)
    crf = toxicity.Crf(start=draw.normal(size=2), moves=draw.normal(size=(2, 2)))
    emissions = draw.normal(size=9) * 2
    firsts = np.zeros(9, bool)
    firsts[[0, 1, 5]] = True
    weight = np.zeros((9, 2))
    for path in itertools.product((0, 1), repeat=9):
        total = sum(
            (crf.start[y] if firsts[t] else crf.moves[path[t - 1], y]) + y * emissions[t] for t, y in enumerate(path)
        )
        for t, y in enumerate(path):
            weight[t, y] += np.exp(total)
    want = weight[:, 1] / weight.sum(axis=1)
    for block in (2, 4, 64):
        assert np.allclose(toxicity.marginals(crf, emissions, firsts, block), want)


def test_toxic_documents_are_found(spark, edges, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    report = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").collect()
    unseen = [r for r in report if r["held_out"]]
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in unseen} == {True}
    right = Counter((r["toxic"], r["predicted"]) for r in unseen)
    assert right[1, 1] >= 0.75 * (right[1, 1] + right[1, 0])
    assert right[0, 0] >= 0.99 * (right[0, 0] + right[0, 1])
    assert all((r["predicted"] == 1) == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in report)
    texts = dict(pairs(docs))
    some = next(r for r in unseen if r["predicted"])
    assert all(texts[r["doc_id"]][s["start"] : s["end"]].strip() for r in [some] for s in r["spans"])
    crf = toxicity.learn(docs, labels)
    assert toxicity.score(edges, crf).count() == edges.count()
    assert toxicity.score(nothing, crf).count() == 0
    assert toxicity.keep_clean(edges, labels).columns == edges.columns


def test_nothing_to_learn_from(spark, edges):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity_report(edges, labels).collect()} == {0}
