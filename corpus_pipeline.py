"""From raw documents to token ids: five stages, each one of the training-data operators with its production parameters.

Each stage reads what the one before wrote. All but the last return the columns of `documents`:

    language ID       documents without a letter, or that no learned language explains, go
    line dedup        lines that repeat an earlier line (Jaccard 0.8 of their words) go, and documents left without a word
    SimHash           of each group of near-duplicates (3 bits of 64, shingles of 3 words) the smallest doc_id stays
    decontamination   documents that hold a window of a benchmark item go
    SentencePiece     sampled piece ids, and whether they decode to the text
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import decontaminate, language, linededup, pieces, simhash
from peakloom.llm.common import stored, text_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.deduplicate(docs)
    return out.select(*[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else f"`{c}`" for c in out.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, piece_ids, lossless."""
    text_batches(spark)
    out = docs.select("doc_id", "lang", "source", pieces.encode_checked(F.col("text"), F.col("doc_id")).alias("p"))
    return out.select("doc_id", "lang", "source", F.size("p.ids").cast("bigint").alias("n_pieces"), F.col("p.ids").alias("piece_ids"), "p.lossless")


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("benchmark decontamination", remove_benchmarks),
    ("SentencePiece encoding", encode_pieces),
]

#: Language models, SimHash and sampling are beyond SQL: tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
