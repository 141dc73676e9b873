"""Driver queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, hard_negatives, licenses, mixing, pii, preference, simhash, suffix_repeats, tokens_orc, topk, toxicity, warczip
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warczip.archive_and_read(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.repeats(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_components(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.table_pairs(table(spark, sf_dir, "conversations"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_orc.tokenized(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mixing, op2_warc, op3_pii, op4_suffix_repeats, op5_simhash, op6_decontaminate, op7_preference, op8_tokens, op9_topk, op10_toxicity, op11_hard_negatives, op12_divergence, op13_licenses)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op2_warc": warczip.ORACLE, "op7_preference": preference.ORACLE, "op9_topk": topk.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_divergence": divergence.ORACLE}
