"""A training corpus from `documents`: toxicity, near copies, benchmark leaks, source weights, token files.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; stages are written as
Parquet and read again. The first four return the columns of documents, the last a row per document
of the token files. Each stage gives an empty result for an empty table and keeps other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontaminate, mixing, simhash, tokens_orc, toxicity
from folio.llm.common import passing_tables, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; labels of the documents at hand are learned from, but for a fifth.

    Null and empty texts are scored as empty ones, repeated rows alike, rows with a null doc_id too. With
    labels of one kind only all scores are that kind; without labels everything stays.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of copies and of texts with five-word shingles of similarity 0.8 or more, linked in groups, the least doc_id stays.

    Texts without words are copies of each other. Rows with a null doc_id all stay; of rows that repeat a
    doc_id the one of least text counts.
    """
    return simhash.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null and empty texts and items overlap with nothing, rows with a null doc_id are judged too."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: 0 to 3 times. A null source is a source of its own, rows that repeat a doc_id are taken alike."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files: doc_id, start, n_tokens, ids_crc32, read from them. Null and empty texts have the end id alone, null ids come first."""
    return tokens_orc.tokenized(docs, remembered=100_000)  # its workers hold what earlier stages left


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: The models, links and token ids of the stages are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the token files; the tables of the stages before are deleted."""
    docs = table(spark, sf_dir, "documents")
    with passing_tables(spark):  # the last stage has written its files when it returns, and its rows are read from these alone
        for n, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if n < len(STAGES) - 1:
                docs = written(docs, name)
    return docs
