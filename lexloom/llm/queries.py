"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hidden_markov, language_id, line_dedup, mixing, multi_index, prob_minhash, quality_rules, repair_store, sentence_pieces, warc_bundles
from .common import table, tokenizer_file, work_dir, written

#: ``[\x20\x09-\x0D]`` as DuckDB text.
_SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.indexed(spark, docs, work_dir(spark, "lines"), min_chars=10).apply(docs)
    return cut.select("doc_id", F.col("_lx_lines").alias("n_lines"), F.col("_lx_dropped").alias("n_dropped"), F.col("_lx_sha256").alias("kept_sha256"))


OP1_SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SQL_SPACE}), {_SQL_FOLD}) AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= 2),
marked AS (SELECT k.doc_id, k.line, k.i, s.keeper IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = repair_store.write_shards(docs, work_dir(spark, "tokens"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return repair_store.read_shards(spark, manifest)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return multi_index.neighbours(vectors, F.col("id") % 20 == 0, work_dir(spark, "index"), k=20)


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def _fold(n: int):
    """crc32 of doc_id as text, modulo n; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_fold(4) == 2).alias("held_out"))
    network = language_id.fitted(docs.where(~F.col("held_out")))
    found = language_id.predicted(docs.select("doc_id", "held_out", "text"), network)
    return found.select("doc_id", "held_out", F.col("_lx_lang").alias("lang_pred"), F.col("_lx_score").alias("score"))


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_bundles.write_bundles(table(spark, sf_dir, "pages"), work_dir(spark, "warc"), least=0)
    return warc_bundles.read_bundles(spark, index)


OP5_SQL = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
heads AS (SELECT h, min(page_id) AS least FROM hashed GROUP BY h)
SELECT p.page_id, strlen(p.payload) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(p.h, CAST((j // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = s.least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = s.least THEN NULL ELSE s.least END AS refers_to
FROM hashed p JOIN heads s ON p.h = s.h
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "mix")
    rows = written(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size")), f"{root}/rows")
    mix = mixing.Mix(rows, root)
    sources = mix.sources.select("_lx_src", "_lx_nul", "source_size", "target")
    taken = mixing.keyed(mix.applied(rows)).join(sources, ["_lx_src", "_lx_nul"])
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_lx_copies")).alias("taken"), F.col("_lx_copies").alias("copies"), F.array_join(F.col("_lx_shards").cast("array<string>"), ",").alias("shards"))


def op8_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.classified(table(spark, sf_dir, "documents"), work_dir(spark, "near"))


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (_fold(10) == 0).alias("held_out"))
    return hidden_markov.scored(docs, work_dir(spark, "hmm"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), work_dir(spark, "quality"))


_SQL_WORD = r"[^\x20\x09-\x0D]+"
OP10_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '{_SQL_WORD}') AS w FROM docs),
windows AS (SELECT r, i, array_to_string(list_slice(w, i, i + {quality_rules.WINDOW - 1}), ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {quality_rules.WINDOW - 2}, 1))) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n >= 2),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {quality_rules.WINDOW})) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, doc_id, source, line, translate(trim(line, {_SQL_SPACE}), {_SQL_FOLD}) AS key FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs)),
full_lines AS (SELECT * FROM lines WHERE key <> ''),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(strlen(key)) AS line_bytes FROM full_lines GROUP BY r),
hosts AS (SELECT source, greatest({quality_rules.LEAST}, count(*) * {quality_rules.SHARE}) AS most FROM docs GROUP BY source),
often AS (SELECT l.source, l.key, min(l.doc_id) AS least FROM full_lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, l.key, h.most HAVING count(DISTINCT l.r) > h.most),
removed AS (SELECT l.r, sum(strlen(l.key)) AS gone FROM full_lines l JOIN often o ON l.key = o.key AND l.source IS NOT DISTINCT FROM o.source WHERE l.doc_id IS DISTINCT FROM o.least GROUP BY l.r),
counted AS (SELECT w.r, w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(d.n_dup_lines, 0) AS n_dup_lines, coalesce(p.n_repeat_words, 0) AS n_repeat_words, coalesce(g.gone, 0) AS removed_bytes, coalesce(d.line_bytes, 0) AS line_bytes
  FROM words w LEFT JOIN dups d ON w.r = d.r LEFT JOIN repeats p ON w.r = p.r LEFT JOIN removed g ON w.r = g.r),
failed AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CAST(removed_bytes AS BIGINT) AS removed_bytes, CAST(line_bytes AS BIGINT) AS line_bytes,
  NOT base_failed AND NOT (line_bytes - removed_bytes < {quality_rules.DEPLETED} * line_bytes) AS kept FROM failed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:2] == "op" and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_warc_bundles": OP5_SQL, "op10_quality_rules": OP10_SQL}
