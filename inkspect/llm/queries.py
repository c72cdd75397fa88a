"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkspect.llm import (
    decontaminate, linededup, lm, maintext, neardup, packing, prefixtrie, quality, resampling, secrets, tokencount, toxicity, vectors,
)
from inkspect.llm.common import read


def op1_minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return neardup.report(read(spark, d, "documents"))


def op2_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.report(read(spark, d, "documents"), read(spark, d, "benchmark"))


def op3_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.report(read(spark, d, "documents"))


def op4_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return maintext.extract(read(spark, d, "pages"))


def op5_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"))


def op6_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return lm.score(read(spark, d, "documents"))


def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return linededup.report(read(spark, d, "documents"))


def op8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokencount.count(read(spark, d, "documents"))


def op9_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return vectors.report(read(spark, d, "embeddings"))


def op10_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(read(spark, d, "documents"), read(spark, d, "labels"))


def op11_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resampling.resample(read(spark, d, "documents"), read(spark, d, "benchmark"))


def op12_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classify(read(spark, d, "documents"), read(spark, d, "labels"))


def op13_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefixtrie.trie(read(spark, d, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_secret_scan": op3_secret_scan,
        "op4_html_extraction": op4_html_extraction,
        "op5_packing": op5_packing,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_line_dedup": op7_line_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_toxicity": op12_toxicity,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": neardup.SQL,
        "op2_decontamination": decontaminate.SQL,
        "op3_secret_scan": secrets.sql(),
        "op9_embedding_dedup": vectors.SQL,
        "op11_importance_resampling": resampling.SQL,
        "op13_prefix_trie": prefixtrie.SQL,
    }
