"""Semantic locating: recall of segments by a pluggable retriever, ranking, and alignment inside the best segments.

A retriever is a function from (excerpt, segment) Columns to a score Column, or any function of two DataFrames with the
columns used here; the one supplied scores the share of an excerpt's characters that a segment holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.negation import detect_negation, negations_conflict
from ..functions.rules import HOLD
from ..functions.scalars import clamp01
from ..options import MatchOptions, with_preset
from .locate import RESULT, _arrays, _fields, _row, blocks, locate, normalized_column
from .pairs import Matcher, prepare

ENDS = "。！？；.!?;"
SEGMENT = f"[\\n{HOLD}]*([^\\n{ENDS}]*[{ENDS}]|[^\\n{ENDS}]+)"
LONGEST = 300


def split_segments(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """doc_id, seg_index, start (0-based code points) and segment: cut at newlines and after sentence ends, and hard at ``longest``.

    All is computed within the row of a document; nothing is shuffled.
    """
    whole, own = (F.regexp_extract_all("text", F.lit(SEGMENT), F.lit(g)) for g in (0, 1))
    ends = F.aggregate(whole, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(w))))
    rows = docs.select("doc_id", own.alias("own"), ends.alias("ends"))
    starts = F.transform("own", lambda x, k: F.struct((F.get("ends", k + 1) - F.length(x)).alias("at"), x.alias("own")))
    cuts = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p["own"]) - 1) / F.lit(longest)).cast("int")), lambda i: F.struct((p["at"] + i * longest).alias("start"), F.substring(p["own"], i * longest + 1, F.lit(longest)).alias("segment")))
    pieces = F.flatten(F.transform(F.filter(starts, lambda p: p["own"] != ""), cuts))
    return rows.select("doc_id", F.posexplode(pieces).alias("seg_index", "piece")).select("doc_id", "seg_index", "piece.start", "piece.segment")


def overlap_score(excerpt: Column, segment: Column) -> Column:
    """Share of the excerpt's characters that occur in the segment."""
    held = F.size(F.filter(F.split(excerpt, ""), lambda c: (c != "") & F.contains(segment, c)))
    return held / F.greatest(F.lit(1), F.length(excerpt))


def recall(segments: DataFrame, excerpts: DataFrame, retriever: Callable[[Column, Column], Column] = overlap_score, top_k: int = 3, least: float = 0.5, check_polarity: bool = True, on: list[str] | None = None) -> DataFrame:
    """The best ``top_k`` segments of each (doc_id, item_id) pair, with recall_rank; pairs are those that ``on`` joins."""
    scored = segments.join(excerpts, on or ["doc_id"]).withColumn("recall_score", retriever(F.col("excerpt"), F.col("segment"))).where(F.col("recall_score") >= least)
    if check_polarity:
        scored = scored.where(~negations_conflict(F.col("excerpt"), F.col("segment")))
    rank = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("recall_score"), "seg_index")
    return scored.withColumn("recall_rank", F.row_number().over(rank) - 1).where(F.col("recall_rank") < top_k)


def recall_corpus(docs: DataFrame, excerpts: DataFrame, top_k: int = 3, least: float = 0.5, check_polarity: bool = True) -> DataFrame:
    """For every excerpt (item_id, excerpt) the best ``top_k`` of all segments of all documents, by the share of its characters.

    Excerpts go out in blocks of bounded size; each task scores its segments against all of them by one matrix product and
    keeps the best of each excerpt, so what is shuffled is at most ``top_k`` rows an excerpt and task. Ties fall to the least
    doc_id, then the first segment; segments of opposite polarity are passed over. Null excerpts and texts recall nothing.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), excerpts.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, excerpt string, seg_index int, start int, segment string, recall_score double"
    id_type = to_arrow_type(excerpts.schema["item_id"].dataType)
    segments = split_segments(docs)
    out = None
    for rows in blocks(excerpts, ["item_id", "excerpt"], limit=2_000_000):
        shared = docs.sparkSession.sparkContext.broadcast([(i, e) for i, e in rows if e])

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            alphabet = sorted({c for _, e in rows for c in e})
            code = {c: k for k, c in enumerate(alphabet)}
            counts = np.zeros((len(alphabet), len(rows)))
            for j, (_, e) in enumerate(rows):
                for c in e:
                    counts[code[c], j] += 1
            odd = [len(detect_negation(e)) % 2 for _, e in rows]
            length = np.array([len(e) for _, e in rows])
            best: list[list[tuple]] = [[] for _ in rows]
            for b in source:
                texts = b.column("segment").to_pylist()
                held = np.zeros((len(texts), len(alphabet)))
                for k, t in enumerate(texts):
                    held[k, [code[c] for c in set(t) if c in code]] = 1
                ids, places, starts = (b.column(c).to_pylist() for c in ("doc_id", "seg_index", "start"))
                score = (held @ counts) / length
                order = sorted(range(len(texts)), key=lambda k: (ids[k] is not None, ids[k], places[k]))
                rank = np.empty(len(texts), dtype=np.int64)
                rank[order] = np.arange(len(texts))
                polarity: dict[int, int] = {}
                for j, own in enumerate(best):
                    floor = max(least, -own[-1][0]) if len(own) == top_k else least
                    near = np.flatnonzero(score[:, j] >= floor)
                    fresh = 0
                    for k in near[np.lexsort((rank[near], -score[near, j]))].tolist():
                        if fresh == top_k:
                            break
                        if not check_polarity or polarity.setdefault(k, len(detect_negation(texts[k])) % 2) == odd[j]:
                            own.append((-score[k, j], ids[k] is not None, ids[k], places[k], starts[k], texts[k]))
                            fresh += 1
                    own.sort(key=lambda r: r[:4])
                    del own[top_k:]
            found = [(*r, j) for j, own in enumerate(best) for r in own]
            columns = list(zip(*found)) or [()] * 7
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[2], to_arrow_type(docs_id)), pa.array([rows[j][0] for j in columns[6]], id_type), pa.array([rows[j][1] for j in columns[6]], pa.string()),
                pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.string()), pa.array([-x for x in columns[0]], pa.float64()),
            ], names=["doc_id", "item_id", "excerpt", "seg_index", "start", "segment", "recall_score"])

        docs_id = docs.schema["doc_id"].dataType
        part = segments.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    rank = Window.partitionBy("item_id", "excerpt").orderBy(F.desc("recall_score"), "doc_id", "seg_index")
    return out.withColumn("recall_rank", F.row_number().over(rank) - 1).where(F.col("recall_rank") < top_k)


def searched(docs: DataFrame, o: MatchOptions) -> DataFrame:
    """doc_id and the normalised text of what a document shows, in whose coordinates segments are aligned."""
    if not (o.markdown or o.cjk_numerals or o.ignore_particles):
        return docs.select("doc_id", normalized_column("text", o).alias("text"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            shown = [prepare(t, o).views[0].norm.text if t else t for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shown, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def locate_or_recall(docs: DataFrame, excerpts: DataFrame, o: MatchOptions | None = None, min_score: float = 0.0, least: float = 0.6) -> DataFrame:
    """All tiers in one call: the hits of ``locate``, and for each excerpt that has none the best of what recall names: a segment
    that aligns, or else the segment itself."""
    o = o or with_preset()
    hits = locate(docs, excerpts, o, min_score)
    missed = excerpts.join(hits.select("item_id").distinct(), "item_id", "left_anti")
    asked = missed.select("item_id", normalized_column("text", replace(o, markdown=None)).alias("excerpt"))
    recalled = recall_corpus(searched(docs, o), asked, check_polarity=o.check_polarity)
    last = semantic_matches(docs, recalled, o, least).where("found").where(F.col("score") >= min_score)
    order = Window.partitionBy("item_id").orderBy(F.col("via") != "semantic", F.desc("score"), "doc_id")
    return hits.unionByName(last.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth"))


def normalize_scores(rows: DataFrame, score: str = "recall_score", by: tuple[str, ...] = ("doc_id", "item_id")) -> DataFrame:
    """Min-max scores within a pair; equal scores are all 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("norm_score", F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def segment_fallback(recalled: DataFrame, by: tuple[str, ...] = ("doc_id", "item_id")) -> DataFrame:
    """The top segment of each pair with its score as a segment-level hit."""
    return normalize_scores(recalled, by=by).where("recall_rank = 0").withColumn("score", clamp01(F.col("norm_score") * 0.9))


def semantic_matches(docs: DataFrame, recalled: DataFrame, o: MatchOptions | None = None, least: float = 0.6) -> DataFrame:
    """Aligned hits, or segment hits, of recalled pairs, as result rows; the segments are those of ``searched`` documents."""
    o = o or with_preset()
    ranked = recalled.groupBy("doc_id", "item_id").agg(F.first("excerpt").alias("excerpt"), F.array_sort(F.collect_list(F.struct("recall_rank", "start", "segment", "recall_score"))).alias("segments"))
    rows = ranked.join(docs.select("doc_id", F.col("text").alias("document")), "doc_id")
    keys = rows.select("doc_id", "item_id").schema

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(o)
        for b in source:
            found = []
            for text, excerpt, segments in zip(*(b.column(c).to_pylist() for c in ("document", "excerpt", "segments"))):
                parts = [(s["start"], s["segment"], s["recall_score"]) for s in segments]
                found.append(_row(matcher.semantic(excerpt, text, parts, least=least), text, o, 0.0))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name).cast(to_arrow_type(f.dataType)) for f in keys), *_arrays(found)], names=[*(f.name for f in keys), *(n for n, _ in _fields())])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", " + RESULT)
