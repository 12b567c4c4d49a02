"""The opN_ queries: each operator with production parameters over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, decontamination, katz, line_dedup, mixing, ngram_join, preference, quality_rules, repeat_dedup
from .textcore import documents, table


def op1_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir)).drop("node")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("lang", "source")


def op7_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.preference_pairs(table(spark, sf_dir, "conversations"))
    return out.withColumns({c: preference.spans_text(c) for c in ("chosen_mask", "rejected_mask")})


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_dedup.repeat_dedup(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_join": ngram_join.join_sql(), "op5_mixing": mixing.mixing_sql(), "op7_preference_formatting": preference.preference_sql(), "op9_suffix_dedup": repeat_dedup.repeat_sql(), "op10_line_dedup": line_dedup.line_dedup_sql()}
