"""The opN queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakequill.llm import jaccard, licenses, mixing, packing, quality_model, quality_rules, repeats, secrets, topk, toxicity
from lakequill.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.op2(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op3(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op5(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op6(table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op9(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10(table(spark, sf_dir, "documents"))


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.base_counts(table(spark, sf_dir, "documents"))


def base_license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.base_places(table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_targets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_secret_scan": op3_secret_scan,
    "op4_source_mix": op4_source_mix,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality_model": op7_quality_model,
    "op8_quality_rules": op8_quality_rules,
    "op9_exact_topk": op9_exact_topk,
    "op10_license_scan": op10_license_scan,
    # the columns of op8, op10 and op4 that SQL can express, held to it
    "base_quality_counts": base_quality_counts,
    "base_license_places": base_license_places,
    "mix_targets": mix_targets,
}

ORACLES: dict[str, str] = {
    "op2_repeated_passages": repeats.SQL,
    "op3_secret_scan": secrets.SQL,
    "op6_ngram_jaccard": jaccard.SQL,
    "op9_exact_topk": topk.SQL,
    "base_quality_counts": quality_rules.BASE_SQL,
    "base_license_places": licenses.BASE_SQL,
    "mix_targets": mixing.TARGET_SQL,
}
