"""The training-data pipeline over ``documents``: each stage works on all documents that the stage before it kept.

Stages, in order: language identification drops texts without a letter and texts whose language is unclear; line
deduplication takes lines out that an earlier document holds; near-duplicate detection keeps the smallest document of each class; mixing
repeats or leaves out documents so that sources come to their target weights; encoding turns texts into ids. All stages but the last return the columns
of ``documents``, and any others that came with them. Null texts and null columns pass through each stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import language_id, line_dedup, mixing, prob_minhash, sentence_pieces
from lexloom.llm.common import tokenizer_file, work_dir, written

#: A text stays if its language's mean probability is at least this; short texts of one language lie well above.
MIN_LANGUAGE_SCORE = 0.3


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a letter whose language is clear; without a labelled text nothing is known of languages, and every text with a letter stays."""
    network = language_id.fitted(docs.select("doc_id", "text", "lang"))
    if network is None:
        return docs.where(language_id.has_letter(F.col("text")))
    judged = language_id.predicted(docs, network)
    return judged.where((F.col("_lx_lang") != language_id.UNKNOWN) & (F.col("_lx_score") >= MIN_LANGUAGE_SCORE)).select(_own(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines; a document that loses every line with a word goes, and n_chars follows the text."""
    cut = line_dedup.indexed(spark, docs, work_dir(spark, "lines")).apply(docs)
    changed = F.col("_lx_dropped") > 0
    kept = cut.where(~changed | F.col("_lx_text").rlike(r"[^\x20\x09-\x0D]"))
    values = {"text": F.when(changed, F.col("_lx_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.length("_lx_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumns(values).select(_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prob_minhash.kept(docs, work_dir(spark, "near")).select(_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "mix")
    rows = written(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size")), f"{root}/rows")
    return mixing.mixed_rows(docs, mixing.Mix(rows, root)).select(_own(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoded(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentence_pieces", encode),
]

#: Language identification, signatures and encoding are no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is written and read again."""
    root = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"{root}/{number}-{name}")
    return docs
