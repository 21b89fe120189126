"""The operators applied to their whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from . import cap_filters, decontaminate, lm_score, nbsvm, ngram_join, packing, pii, preference, secret_scan, suffix_dedup


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def near_dedup_planted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicate_vectors(cap_filters.planted(table(spark, sf_dir, "embeddings")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preferences_from_conversations(table(spark, sf_dir, "conversations"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept, margins = nbsvm.accepted(docs, table(spark, sf_dir, "labels"))
    return kept.select("doc_id", *margins)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_pii": op2_pii,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_lm_scoring": op10_lm_scoring,
    "near_dedup_planted_copies": near_dedup_planted_copies,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": cap_filters.SQL,
    "near_dedup_planted_copies": cap_filters.PLANTED_SQL,
    "op4_chat_formatting": preference.SQL,
    "op6_benchmark_decontamination": decontaminate.SQL,
    "op8_suffix_array_dedup": suffix_dedup.SQL,
    "op9_ngram_jaccard_join": ngram_join.SQL,
}
