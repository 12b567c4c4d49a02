"""Streams of excerpts or documents against a static other side. Every tier is stateless for a pair, so there is no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.locate import exact_pairs, match_pairs
from ..options import MatchOptions


def stream_pairs(excerpts: DataFrame, docs: DataFrame, o: MatchOptions | None = None) -> DataFrame:
    """A stream of (doc_id, item_id, excerpt) rows joined with documents by id and matched, row by row."""
    pairs = excerpts.join(docs.select("doc_id", F.col("text").alias("document")), "doc_id")
    return match_pairs(pairs, o, keys=["doc_id", "item_id"])


def stream_documents(docs: DataFrame, excerpts: DataFrame) -> DataFrame:
    """A stream of documents searched for a static table of excerpts."""
    return exact_pairs(docs, excerpts)


def route(results: DataFrame, on_hit: Callable[[DataFrame], None], on_miss: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hits and misses of every micro-batch go to their own sinks."""

    def each(batch: DataFrame, _: int) -> None:
        on_hit(batch.where(F.col("kind") != "none"))
        on_miss(batch.where(F.col("kind") == "none"))

    return results.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
