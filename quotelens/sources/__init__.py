"""Sources, the prepared index of a corpus, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import rules, to_column
from ..options import MatchOptions, with_preset


def read_documents(spark: SparkSession, path: str, doc_format: str = "parquet") -> DataFrame:
    """doc_id and text: a table, or whole text files with their paths as ids."""
    if doc_format == "text":
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return spark.read.format(doc_format).load(path)


def prepare(docs: DataFrame, o: MatchOptions | None = None) -> DataFrame:
    """The reusable index of a corpus: one row per doc_id with its normalised text beside the source text.

    Equal ids mean equal content, so documents are deduplicated by id before they are normalised. Persist or write it.
    """
    once = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    return once.withColumn("norm", to_column(F.col("text"), rules(o or with_preset())))


def hits(results: DataFrame) -> DataFrame:
    return results.where(F.col("kind") != "none")


def misses(results: DataFrame) -> DataFrame:
    return results.where(F.col("kind") == "none")
