"""The queries of this subpackage: one thin query per operator, applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontamination, jaccard_join, line_dedup, quality_classifier, quality_rules, source_mix, substring_dedup, suffix_dedup, surrogates, token_files

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(_table(spark, sf_dir, "documents"), key="waymark")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_chunks(_table(spark, sf_dir, "documents"), anywhere=True).drop("n_chunks")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_mix.plan(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = (op1_pii_surrogates, op2_ngram_jaccard_join, op3_quality_rules, op4_token_binary_output, op5_line_dedup, op6_benchmark_decontamination, op7_quality_classifier, op8_source_mix, op9_substring_dedup, op10_suffix_array_dedup)
    return {f.__name__: f for f in every}
