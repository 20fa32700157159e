"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    centroids,
    chunking,
    class_lm,
    decontaminate,
    exact_dedup,
    language_id,
    merkle,
    mixing,
    near_dedup,
    pii,
    preference,
    quality,
    suffix_dedup,
)
from .shared import workers_import_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    workers_import_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def format_preferences(spark: SparkSession, folder: str) -> DataFrame:
    turns = preference.reply_pairs(table(spark, folder, "conversations"))
    return preference.formatted_pairs(turns)


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(documents(spark, folder))


def exact_dedup_documents(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


def score_by_classes(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.held_out_scores(documents(spark, folder))


def remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removed_spans(documents(spark, folder))


def remove_repeated_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_dedup(documents(spark, folder))


def identify_language(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.held_out_predictions(documents(spark, folder))


def find_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, folder), table(spark, folder, "benchmark"))


def find_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(documents(spark, folder))


def near_dedup_documents(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, folder))


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified_documents(documents(spark, folder))


def centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clusters(table(spark, folder, "embeddings"))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(documents(spark, folder))


QUERIES: dict[str, Query] = {
    "op1_format_preferences": format_preferences,
    "op2_mix_sources": mix_sources,
    "op3_score_by_classes": score_by_classes,
    "op4_remove_repeats": remove_repeats,
    "op5_identify_language": identify_language,
    "op6_remove_repeated_chunks": remove_repeated_chunks,
    "op7_find_benchmark_leaks": find_benchmark_leaks,
    "op8_find_personal_data": find_personal_data,
    "op9_exact_dedup": exact_dedup_documents,
    "op10_near_dedup": near_dedup_documents,
    "op11_merkle_manifest": merkle_manifest,
    "op12_centroid_clusters": centroid_clusters,
    "op13_quality_rules": quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_format_preferences": preference.ORACLE_SQL,
    "op2_mix_sources": mixing.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_centroid_clusters": centroids.ORACLE_SQL,
    "op13_quality_rules": quality.ORACLE_SQL,
}
