"""The registered queries of this subpackage: each applies its operator to the whole documents table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chunk_dedup, conversation_trie, fingerprints, importance, language_id, license_scan, log_bilinear, ngram_join, packing, quality_rules, secret_scan, token_records
from .common import documents

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.query(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.query(documents(spark, sf_dir))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("blocks")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_BPE)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_query(documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.codec_digests(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.digest_query(documents(spark, sf_dir), WORD_BPE)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.query(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.query(spark, sf_dir)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.query(spark, sf_dir)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_language_id, op3_substring_dedup, op4_license_scans, op5_quality_rules, op6_packing, op7_secret_scans, op8_byte_bpe, op9_token_records, op10_ngram_join, op11_conversation_trie, op12_importance_resampling, op13_lm_scoring)}
ORACLE_SQL: dict[str, str] = {"op4_license_scans": license_scan.oracle_sql(), "op5_quality_rules": quality_rules.ORACLE, "op10_ngram_join": ngram_join.ORACLE, "op11_conversation_trie": conversation_trie.ORACLE, "op12_importance_resampling": importance.ORACLE}
