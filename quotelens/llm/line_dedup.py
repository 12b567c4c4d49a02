"""Line dedup by winnowing: later copies of runs of lines are deleted.

A run is three or more consecutive lines, or one or two lines with ``long_words`` words in all; blank lines do not count
and are never deleted. Of every window of ``window`` lines the line of least hash is selected (winnowing), so any run of
that length shares a selected line with its copies; of one or two lines with enough words the longest is. Only selected
lines are fingerprints: their positions are joined with those of equal lines, and where a line is selected at more than
one place the match is extended to the left and to the right over the windows that selected it. Windows that are equal
there make up the runs, and the later ones are deleted; the first place of a window always stays.

Defined cases: null text stays null; texts without lines of words are unchanged; the order of places is doc_id (null
first), a digest of the text, line; rows repeated with one doc_id and text are one document; lines are compared as whole
byte strings; columns other than doc_id, text and n_chars pass through under their own names, but those named as what
``line_dedup`` adds or joins (``RESERVED``) give way to it. A document left without
any line of words by deletions is reported with empty text. A long text is read whole, and its windows are gathered in one row
of the document. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import U64, Words, batches, mix, slice_hashes, stored


COUNTS = ["n_lines", "n_removed", "n_runs"]
RESERVED = [*COUNTS, "run_doc", "run_digest", "runs"]


@dataclass(frozen=True)
class LineConfig:
    window: int = 3  #: lines in which a least hash is selected; runs of as many lines are found for certain
    long_words: int = 50  #: words that make a run of one or two lines
    hot: int = 2000  #: keys with more than this part of all rows are joined by broadcast


def _lines(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-blank lines of all texts: hash, words, text and number within the text (blank lines count there)."""
    w = Words(texts, lower=False, hashes=False)
    ends = np.flatnonzero(w.data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    words = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
    doc = np.searchsorted(w.text_start, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, w.text_start[:-1])[doc]
    filled = words > 0
    return w, slice_hashes(w.data, starts[filled], ends[filled]), words[filled], doc[filled], number[filled]


def positions(docs: DataFrame, config: LineConfig) -> DataFrame:
    """doc_id, digest, fp (hash of a selected line) and windows (array of struct line, n, hash): those that selected it, and so
    the ways in which a match of the line extends to the left and right. Lines are numbered without blank ones."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source, "text"):
            _, h, words, doc, _ = _lines(texts)
            if not len(h):
                continue
            first = np.searchsorted(doc, np.arange(len(texts)))
            line = np.arange(len(h)) - first[doc]
            left = np.bincount(doc, minlength=len(texts))[doc] - line
            found = []
            for n in range(1, config.window + 1):
                m = len(h) - n + 1
                if m <= 0:
                    break
                total = sum(words[j : j + m] for j in range(n))
                at = np.flatnonzero((left[:m] >= n) & ((total >= config.long_words) if n < config.window else True))
                value = np.full(len(at), n, dtype=U64)
                for j in range(n):
                    value = mix(value * U64(31) + h[at + j])
                own = [h[at + j] if n == config.window else -words[at + j] for j in range(n)]
                found.append((at + (np.stack(own).argmin(axis=0) if len(at) else at), at, np.full(len(at), n), value))
            chosen, at, n, value = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(chosen, kind="stable")
            chosen, at, n, value = chosen[order], at[order], n[order], value[order]
            cut = np.flatnonzero(np.diff(chosen, prepend=-1))
            spot = chosen[cut]
            places = pa.StructArray.from_arrays([pa.array(line[at].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(value.view(np.int64))], names=["line", "n", "hash"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(chosen)).astype(np.int32)), places)
            d = pa.array(doc[spot])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(d), batch.column("digest").take(d), pa.array(h[spot].view(np.int64)), lists], names=["doc_id", "digest", "fp", "windows"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, f"doc_id {kind}, digest bigint, fp bigint, windows array<struct<line:int,n:int,hash:bigint>>")


def _joined(rows: DataFrame, keys: DataFrame, on: str, total: int, config: LineConfig) -> DataFrame:
    """``rows`` with the columns of ``keys``, a stored table of ``on``, ``seen`` (how many rows have it) and others.

    Keys of more than a ``hot``-th of all rows are at most ``hot``: they are broadcast, so that no task gets a hot key's rows.
    """
    often = F.col("seen") * config.hot > total
    few = F.broadcast(keys.where(often).drop("seen"))
    rest = rows.join(F.broadcast(keys.where(often).select(on)), on, "left_anti")
    return rows.join(few, on).union(rest.join(keys.where(~often).drop("seen"), on))


def later_windows(docs: DataFrame, config: LineConfig) -> DataFrame:
    """run_doc, run_digest and runs (array of struct line, n) of documents with windows that occur earlier."""
    rows = stored(positions(docs, config))
    again = stored(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1"))
    held = stored(_joined(rows, again, "fp", rows.count(), config).select("doc_id", "digest", F.inline("windows")))
    place = F.struct("doc_id", "digest", "line")
    first = stored(held.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("seen")).where("seen > 1"))
    later = _joined(held, first, "hash", held.count(), config).where(~place.eqNullSafe(F.col("first")))
    runs = later.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("line", "n")).alias("runs"))
    return runs.withColumnsRenamed({"doc_id": "run_doc", "digest": "run_digest"})


def line_dedup(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``docs`` with later runs deleted from text, n_chars brought up to date, and n_lines, n_removed and n_runs added."""
    cut = later_windows(docs, config)
    counts = COUNTS
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESERVED])
    names = docs.columns
    same = F.col("doc_id").eqNullSafe(F.col("run_doc")) & (F.xxhash64("text") == F.col("run_digest"))
    joined = docs.join(cut, same, "left").drop("run_doc", "run_digest")
    schema = docs.schema
    for c in counts:
        schema = schema.add(c, "long")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source, "text"):
            _, _, _, doc, number = _lines(texts)
            total = np.bincount(doc, minlength=len(texts))
            first = np.concatenate([[0], np.cumsum(total)])
            runs = batch.column("runs").to_pylist()
            kept, removed, spans = [], [], []
            for i, t in enumerate(texts):
                gone = np.zeros(total[i] + 1, dtype=bool)
                for r in runs[i] or []:
                    gone[r["line"] : r["line"] + r["n"]] = True
                gone = gone[: total[i]]
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                if removed[-1]:
                    drop = set(number[first[i] : first[i + 1]][gone].tolist())
                    t = b"" if removed[-1] == total[i] else b"\n".join([x for k, x in enumerate(t.split(b"\n")) if k not in drop])
                kept.append(t)
            null = batch.column("text").is_null().to_pylist()
            text = pa.array([None if z else k.decode() for k, z in zip(kept, null)], pa.string())
            cols = {c: batch.column(c) for c in names}
            if "n_chars" in cols:
                changed = pa.array([r > 0 for r in removed])
                cols["n_chars"] = pa.compute.if_else(changed, pa.compute.utf8_length(text).cast(cols["n_chars"].type), cols["n_chars"])
            cols["text"] = text
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=[*names, *counts])

    import pyarrow.compute  # noqa: F401

    return joined.mapInArrow(run, schema)


def emptied_removed(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """``docs`` after line dedup, without documents all of whose lines were copies; all columns stay, whatever their names."""
    mark = uuid.uuid4().hex
    aside = {c: f"{c}_{mark}" for c in docs.columns if c.lower() in RESERVED}
    out = line_dedup(docs.withColumnsRenamed(aside), config)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).drop(*COUNTS)
    return out.withColumnsRenamed({b: a for a, b in aside.items()}).select(*docs.columns)


def line_dedup_sql() -> str:
    """The result of the default parameters over documents with unique doc_ids, for DuckDB."""
    return r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
g AS (SELECT *, lead(line, 1) OVER q AS l1, lead(line, 2) OVER q AS l2, lead(w, 1) OVER q AS w1 FROM f WINDOW q AS (PARTITION BY doc_id ORDER BY k)),
v AS (SELECT doc_id, i, 1 AS n, line AS a, '' AS b, '' AS c FROM g WHERE w >= 50
      UNION ALL SELECT doc_id, i, 2, line, l1, '' FROM g WHERE l1 IS NOT NULL AND w + w1 >= 50
      UNION ALL SELECT doc_id, i, 3, line, l1, l2 FROM g WHERE l2 IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY n, a, b, c ORDER BY doc_id, i) AS nth FROM v),
x AS (SELECT DISTINCT doc_id, i + unnest(range(n)) AS i FROM r WHERE nth > 1),
y AS (SELECT f.doc_id, f.k, f.i, x.i IS NOT NULL AS gone FROM f LEFT JOIN x ON f.doc_id = x.doc_id AND f.i = x.i),
z AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM y),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs FROM z GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) AS kept FROM l LEFT JOIN y ON l.doc_id = y.doc_id AND l.k = y.k WHERE NOT coalesce(y.gone, false) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_runs, 0) AS n_runs,
       sha256(CASE WHEN coalesce(t.n_lines, 0) > 0 AND t.n_removed = t.n_lines THEN '' ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN k ON d.doc_id = k.doc_id"""
