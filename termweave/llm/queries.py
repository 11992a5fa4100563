"""One query per operator of this package over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embedding_dedup, html_text, line_dedup, mixing, pipeline, quality, simhash, substring_dedup, token_files

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.count_repeats(_documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.pack_and_read_back(_documents(spark, sf_dir), BPE_JSON)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.measure_mix(_documents(spark, sf_dir))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(turns.unionByName(extra))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_tokens(_documents(spark, sf_dir), BPE_RANKS, PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest_lines(_documents(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_documents(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_documents(_documents(spark, sf_dir))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.text_lengths(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_files": op2_token_files,
    "op3_source_mix": op3_source_mix,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_text": op10_html_text,
    "pipeline": pipeline.run,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_KEY = "translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_source_mix": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(concat('0:', CAST(doc_id AS VARCHAR))), 1, 15)) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
r AS (SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS full_at FROM w),
p AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - 2 * CAST(coalesce(sum(source_size) OVER before, 0) AS DOUBLE) AS words_left,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS weight_left
  FROM r WINDOW before AS (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, words_left / weight_left >= full_at AS capped FROM p),
level AS (SELECT arg_min(words_left / weight_left, row(full_at, k)) FILTER (WHERE NOT capped) AS per_weight FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE) ELSE weight * per_weight END AS target FROM c, level),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
o AS (
  SELECT d.doc_id, d.size, q.source_size, q.target,
         CASE WHEN q.source_size = 0 THEN 0 ELSE quota // q.source_size END AS full_times,
         CASE WHEN q.source_size = 0 THEN 0 ELSE quota % q.source_size END AS missing,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.u) AS there
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(full_times * size + CASE WHEN upto <= missing THEN size WHEN upto - there >= missing OR there = 0 THEN 0
            ELSE CAST(size AS HUGEINT) * CAST(missing - (upto - there) AS HUGEINT) // CAST(there AS HUGEINT) END AS BIGINT) AS taken
FROM o""",
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.reached = p.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id""",
    "op5_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
u AS (SELECT *, 24 + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) AS chars FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(chars) AS BIGINT) AS formatted_chars FROM u GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op7_line_dedup": rf"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM x),
k AS (SELECT doc_id, n, line, {_KEY} AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.doc_id, k.n, k.line, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS span FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, span) AS times FROM w),
r AS (SELECT doc_id, count(DISTINCT g.i + o.o) AS n_repeat_words FROM g, (SELECT unnest(range(8)) AS o) AS o WHERE times > 1 GROUP BY doc_id),
c AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN r ON d.doc_id = r.doc_id),
m AS (
  SELECT doc_id, max(times) AS most, count(*) AS n_distinct, sum(CASE WHEN regexp_matches(word, '\p{{L}}') THEN 0 ELSE times END) AS letterless, max(length(word)) AS longest
  FROM (SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL) GROUP BY doc_id),
b AS (
  SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^[\x20\x09-\x0D]*[-*+•‣●◦]')) AS bullets, count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS ellipses
  FROM l GROUP BY doc_id),
v AS (
  SELECT c.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, most, n_distinct, letterless, longest, bullets, ellipses
  FROM c LEFT JOIN m ON m.doc_id = c.doc_id LEFT JOIN b ON b.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
            OR 10 * most > 4 * n_words OR 50 * n_distinct < n_words OR 2 * letterless > n_words OR longest > 1000 OR 10 * bullets > 9 * n_lines OR 10 * ellipses > 3 * n_lines) AS kept
FROM v""",
}
