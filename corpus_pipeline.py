"""Corpus pipeline: stages over the documents table, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotelens.llm.compression import rejected_removed
from quotelens.llm.decontamination import leaked_removed
from quotelens.llm.line_dedup import emptied_removed
from quotelens.llm.mixing import mix_documents
from quotelens.llm.ngram_join import JoinConfig, near_duplicates_removed
from quotelens.llm.textcore import discard_paths, free_shuffles, shared_dir, stored, stored_tables, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    return rejected_removed(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; those that were copies throughout go.

    They are stored: whoever holds the frame while the next stage runs would else hold the texts' shuffle files too.
    """
    out = stored(emptied_removed(docs))
    free_shuffles(spark)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return near_duplicates_removed(docs, JoinConfig(k=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return leaked_removed(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document that came this far."""
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


_earlier: set[str] = set()


def _after_the_last(stage: Stage) -> Stage:
    """A stage is called once the one before it is written: what that one stored on the way can go."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_paths(_earlier)
        free_shuffles(spark)
        before = stored_tables()
        out = stage(spark, docs, sf_dir)
        _earlier.clear()
        _earlier.update(stored_tables() - before)
        return out

    return call


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _after_the_last(quality_classifier)),
    ("line dedup", _after_the_last(line_dedup)),
    ("n-gram Jaccard join", _after_the_last(near_duplicates)),
    ("benchmark decontamination", _after_the_last(decontamination)),
    ("mixing sources to target weights", _after_the_last(mixing)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs


#: The classifier and the alignment stage have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None
