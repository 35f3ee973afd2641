"""One query for each operator, over its whole table, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import (
    byte_bpe,
    chat_format,
    divergence,
    exact_dedup,
    line_dedup,
    mixing,
    passages,
    simhash,
    spelling,
    token_files,
    toxicity,
    unigram_counts,
    vector_dedup,
)
from topicspark.llm.common import new_folder, read, stored
from topicspark.llm.registry import ORACLES, QUERIES, case

__all__ = ["ORACLES", "QUERIES"]

_MIX_SQL = """
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE)
      / 281474976710656::DOUBLE AS u
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    ([3.0, 1.0, 2.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sizes GROUP BY source),
levels AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM per_source
  WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap
    ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target
  FROM levels),
shares AS (
  SELECT *, floor(copies) AS whole, copies - floor(copies) AS part, target - floor(copies) * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies FROM targets)),
ranked AS (
  SELECT s.doc_id, s.source, t.rest, sum(s.size) AS size, (u / (1 - u)) / (t.part / (1 - t.part)) AS rank
  FROM sizes s JOIN shares t ON s.source IS NOT DISTINCT FROM t.source WHERE t.part > 0
  GROUP BY s.doc_id, s.source, t.rest, t.part, u),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto
  FROM ranked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST) AS place FROM summed),
firsts AS (
  SELECT source, min(place) AS out, min(upto - size) AS held FROM placed WHERE upto > rest GROUP BY source),
lacking AS (
  SELECT p.doc_id, p.source, p.place, f.out, rest - held AS lacks, abs(rest - held - size) AS off
  FROM placed p LEFT JOIN firsts f ON p.source IS NOT DISTINCT FROM f.source),
nearest AS (
  SELECT source, arg_min(place, (off, place)) AS place FROM lacking WHERE place >= out AND off < lacks GROUP BY source),
chosen AS (
  SELECT l.doc_id, l.source FROM lacking l LEFT JOIN nearest n
    ON l.source IS NOT DISTINCT FROM n.source AND l.place = n.place
  WHERE l.out IS NULL OR l.place < l.out OR n.place IS NOT NULL),
rows AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CAST(t.whole AS BIGINT)
      + CASE WHEN EXISTS (SELECT 1 FROM chosen c WHERE c.source IS NOT DISTINCT FROM s.source
        AND c.doc_id IS NOT DISTINCT FROM s.doc_id) THEN 1 ELSE 0 END AS copies
  FROM sizes s JOIN shares t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM rows
"""

_OWNERS_SQL = """
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS weight,
    translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS key
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY key ORDER BY weight DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY key) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY key ORDER BY weight DESC, doc_id) AS kept,
  sha256(key) AS text_sha256
FROM keyed
"""

_PASSAGES_SQL = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (
  SELECT doc_id, nr, substr(h, 2 * nr + 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(range(n - 49)) AS nr FROM texts WHERE n >= 50)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
hits AS (SELECT doc_id, nr FROM windows JOIN firsts USING (w) WHERE doc_id > first),
spans AS (
  SELECT doc_id, min(nr) AS s, max(nr) + 50 AS e
  FROM (SELECT doc_id, nr, sum(CASE WHEN nr <= last + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY nr) AS k
    FROM (SELECT doc_id, nr, lag(nr) OVER (PARTITION BY doc_id ORDER BY nr) AS last FROM hits))
  GROUP BY doc_id, k),
pieces AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM spans
  UNION ALL SELECT t.doc_id, coalesce(max(e), 0), any_value(n) FROM texts t LEFT JOIN spans s ON t.doc_id = s.doc_id GROUP BY t.doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS left_over
  FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(left_over)) AS kept_sha256
FROM texts JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

_VECTORS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(m.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least m ON e.vec_id = m.a
"""

_CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) s(t)),
sized AS (
  SELECT *, length(r || x) + length(r) - length(replace(r, chr(10), ''))
    + list_sum(list_transform(['<|turn|>', '<|end|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>',
      '<|im_start|>', '<|im_end|>', '<|startoftext|>', '<|endoftext|>', '<|system|>', '<|user|>', '<|assistant|>',
      '<|eot_id|>', chr(92)], lambda c: (length(r) - length(replace(r, c, '')) + length(x) - length(replace(x, c, '')))
        // length(c))) AS size
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size + 8 + 1 + 7) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_LINES_SQL = """
WITH lines AS (
  SELECT doc_id, nr, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS nr
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
keys AS (
  SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT l.doc_id, nr, line, coalesce(l.doc_id <> owner, false) AS dropped FROM lines l LEFT JOIN keys k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_DIVERGENCE_SQL = """
WITH found AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
vocabulary AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM found GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
counts AS (
  SELECT f.lang, f.source, f.term, count(*)::HUGEINT AS n
  FROM found f JOIN vocabulary v ON f.lang = v.lang AND f.term = v.term GROUP BY f.lang, f.source, f.term),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
every AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
    1 + (1000000000 * (v.n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN vocabulary v ON g.lang = v.lang
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM every WHERE n > 0 AND p > q),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs) QUALIFY part = 'pair' OR rank <= 10
"""

# The checksum's table and the bytes of a run (U+00C0 to U+00FF are 195 and the code less 64 in UTF-8) come from rules.
_FORMS_SQL = """
WITH RECURSIVE step AS (
  SELECT range AS i, 0 AS k, range::BIGINT AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END FROM step WHERE k < 8),
codes AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
bytes AS (
  SELECT doc_id, run, n, [4294967295::BIGINT] || flatten(list_transform(
    string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS bytes
  FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(bytes, lambda acc, b: xor(t[1 + (xor(acc, b) & 255)], acc >> 8)), 4294967295::BIGINT) AS h
  FROM bytes, codes),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT)
      || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (
  SELECT word, n, nr, substr(word, 1, nr - 1) || substr(word, nr + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS nr FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.nr = b.nr AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS form, max(n) AS form_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form,
    CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON k.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk k ON f.word = k.word JOIN forms e ON k.root = e.word AND e.form IS NULL
"""


@case("op1_crf_toxicity")
def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", "tagged", "spans")


@case("op2_pareto_mix", _MIX_SQL)
def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


@case("op3_covering_simhash")
def op3_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


@case("op4_orc_tokens")
def op4_orc_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = new_folder(spark, "orc-tokens")
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(read(spark, sf_dir, "documents"), folder, tokenizer, end_id=2)
    return token_files.token_digest(token_files.read_tokens(spark, folder))


@case("op5_previous_factors", _PASSAGES_SQL)
def op5_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages.remove_repeats(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@case("op6_sorted_projections", _VECTORS_SQL)
def op6_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


@case("op7_prefix_bpe")
def op7_prefix_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.encode_texts(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@case("op8_schema_chat", _CHAT_SQL)
def op8_schema_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    formatted = chat_format.format_records(chat_format.conversation_records(turns))
    return chat_format.digest(stored(formatted, "chat"))


@case("op9_unigram_counts")
def op9_unigram_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """The vocabulary is that of the 32k piece model in its order, scored by rank."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    pieces = [piece for piece, _ in unigram_counts.sentencepiece_vocabulary(model)]
    return unigram_counts.count_tokens(read(spark, sf_dir, "documents"), unigram_counts.zipf_scores(pieces))


@case("op10_exact_owners", _OWNERS_SQL)
def op10_exact_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_owners(read(spark, sf_dir, "documents"))


@case("op11_range_lines", _LINES_SQL)
def op11_range_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@case("op12_source_divergence", _DIVERGENCE_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"), document="doc_id")


@case("op13_spelling_forms", _FORMS_SQL)
def op13_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(read(spark, sf_dir, "documents"))
