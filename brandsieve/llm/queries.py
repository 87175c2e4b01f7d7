"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brandsieve.llm import (
    chat,
    hamming,
    language_model,
    line_dedup,
    merkle,
    mixing,
    neighbours,
    packing,
    phrases,
    quality,
    secret_scan,
    simhash,
    token_counts,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return hamming.nearest_codes(vectors.select("vec_id", hamming.sign_code(F.col("embedding")).alias("code")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_read(spark, sf_dir, "documents"))


def op5_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_read(spark, sf_dir, "documents"))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_read(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_conversations(chat.probe(_read(spark, sf_dir, "conversations"))).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(_read(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_hamming_top_k": op3_hamming_top_k,
    "op4_secret_scan": op4_secret_scan,
    "op5_elias_fano_lm": op5_elias_fano_lm,
    "op6_cross_polytope": op6_cross_polytope,
    "op7_fair_mix": op7_fair_mix,
    "op8_quality": op8_quality,
    "op9_best_two_fit": op9_best_two_fit,
    "op10_chat_format": op10_chat_format,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_line_dedup": op12_line_dedup,
    "op13_phrases": op13_phrases,
}
ORACLES = {
    "op3_hamming_top_k": hamming.ORACLE,
    "op7_fair_mix": mixing.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
