"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import byte_bpe, chat_format, license_scan, minhash_dedup, mixing, quality_model, quality_rules, repeat_removal, toxicity, vector_dedup
from lectern.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_rows(table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicate_rows(table(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_rows(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_rows(table(spark, sf_dir, "conversations"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_removal.removal_rows(table(spark, sf_dir, "documents"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_quality_model": op3_quality_model,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_repeat_removal": op9_repeat_removal,
    "op10_vector_dedup": op10_vector_dedup,
}
ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
}
