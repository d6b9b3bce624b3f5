"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, dialogue, divergence, jaccard_join, langid, lm_score, oracles, packing, pii, quality_rules, sharding, simhash, token_files, weak_quality
from textloom.llm.common import documents


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the files are not part of this repository."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op2_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir), width=3, percent=90)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(documents(spark, sf_dir))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_lines", "lost_words"
    )


def op5_addressable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.report(documents(spark, sf_dir))


def op9_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op11_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.report(documents(spark, sf_dir))


def op12_joint_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_weak_pii, op2_partenum_jaccard, op3_language, op4_line_frequency, op5_addressable_tokens, op6_forced_boundary_bpe, op7_length_buckets, op8_weak_quality, op9_best_fit_shards, op10_simhash, op11_deleted_interpolation, op12_joint_histograms, op13_conversation_repair]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_partenum_jaccard": oracles.jaccard(3, 90), "op4_line_frequency": oracles.line_frequency(), "op12_joint_histograms": oracles.divergence(), "op13_conversation_repair": oracles.dialogue()}
