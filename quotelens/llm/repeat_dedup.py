"""Repeated-substring dedup: bytes covered by a ``length``-byte string that also starts earlier are removed.

The result is what a generalised suffix array with common prefixes of at least ``length`` would mark. It is found
without sorting all suffixes: every ``length``-byte window has an anchor, the least-hashed ``gram``-byte string in it,
so equal windows have equal anchors at equal offsets.

1. Anchors are counted over the whole corpus (44-bit prefixes, deduplicated per task before the shuffle); those seen
   twice, and those seen in different contexts, set bits of two filters of fixed size. False positives cost work, never
   correctness.
2. Windows whose anchor repeats are sent to a bucket: by a hash of all their bytes where the anchor has one context only,
   else by the anchor and with the bytes. Each task sends a given context once, so one passage in all documents costs a
   bucket one row per task.
3. In a bucket, windows of equal bytes are ordered by place; all but the first are repeats. Their spans go back to the
   documents, where they are merged and cut out.

Exact up to 64-bit hash collisions. Defined cases: null text is empty; the hash of an empty rest is that of no bytes;
rows repeated with the same doc_id and text are one document and get equal results; different texts under one doc_id
are ordered by a digest of the text; null doc_ids come first; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import release
from .textcore import _BYTE, _INV, _POW, _SPAN, U64, bucket_count, deltas, mix, pack, slice_hashes, unpack

PREFIX = 44


@dataclass(frozen=True)
class RepeatConfig:
    length: int = 100  #: bytes of a repeated string
    gram: int = 32  #: bytes of an anchor
    filter_bits: int = 27  #: the filter of repeated anchors has 2**filter_bits bits, whatever the input's size
    segment: int = 1 << 20  #: bytes looked at at once
    hold: int = 8 << 20  #: context bytes that a task holds before it sends them
    spread: int = 2  #: buckets of contexts, and of documents, for each shuffle partition


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes that start at each place."""
    n = len(data) - k + 1
    out = np.empty(max(n, 0), dtype=U64)
    step = _SPAN - k
    for lo in range(0, max(n, 0), step):
        hi = min(n, lo + step)
        total = np.empty(hi - lo + k, dtype=U64)
        total[0] = 0
        np.cumsum(_BYTE[data[lo : hi + k - 1]] * _POW[: hi - lo + k - 1], dtype=U64, out=total[1:])
        out[lo:hi] = mix((total[k:] - total[: hi - lo]) * _INV[: hi - lo])
    return out


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Least key of each run of w keys, by block-wise running minima from both sides."""
    n = len(keys) - w + 1
    if n <= 0:
        return keys[:0]
    size = -(-len(keys) // w) * w
    padded = np.full(size, np.iinfo(U64).max, dtype=U64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _new(sorted_columns: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows differ from the row before."""
    out = np.zeros(len(sorted_columns[0]), dtype=bool)
    out[:1] = True
    for c in sorted_columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class Anchors:
    """Runs of windows with one anchor in a batch of segments: first window, number of windows, place and hash of the anchor."""

    def __init__(self, segments: list[bytes], config: RepeatConfig):
        self.data = np.frombuffer(b"".join(segments), dtype=np.uint8)
        ends = np.cumsum([len(s) for s in segments])
        hashes = rolling(self.data, config.gram)
        keys = (hashes & U64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=U64)
        least = window_minima(keys, config.length - config.gram + 1)
        place = (least & U64(0xFFFFFFFF)).astype(np.int64)
        windows = np.arange(len(place))
        segment = np.searchsorted(ends, windows, "right")
        inside = windows + config.length <= ends[np.minimum(segment, len(ends) - 1)] if len(ends) else windows > 0
        windows, place, segment = windows[inside], place[inside], segment[inside]
        new = np.ones(len(windows), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(new)
        self.start, self.place, self.segment = windows[at], place[at], segment[at]
        self.count = np.diff(np.append(at, len(windows)))
        # Least hashes crowd at the low end of their range; mixed again, they fill filters and buckets evenly.
        self.hash = mix(hashes[self.place])
        self.length = config.length

    def context(self) -> np.ndarray:
        """A hash of all bytes of each run of windows."""
        return slice_hashes(self.data, self.start, self.start + self.count + (self.length - 1))


def segmented(source: Iterator[pa.RecordBatch], config: RepeatConfig) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Segments of texts, overlapping by ``length`` - 1 bytes, with (doc_id or least integer, text digest, offset) of each."""
    segments, places, held = [], [], 0
    step = config.segment
    for batch in source:
        ids = batch.column("doc_id").to_pylist()
        for doc, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist()):
            if text is None or len(text) < config.length:
                continue
            key = (-(1 << 63) if doc is None else doc, text_digest(text))
            for lo in range(0, len(text) - config.length + 1, step):
                part = text[lo : lo + step + config.length - 1]
                segments.append(part)
                places.append((*key, lo))
                held += len(part)
                if held >= step:
                    yield segments, places
                    segments, places, held = [], [], 0
    if segments:
        yield segments, places


def text_digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little", signed=True)


def repeated_anchors(docs: DataFrame, config: RepeatConfig) -> tuple[np.ndarray, np.ndarray]:
    """Two filters, a bit per prefix range: anchors that occur twice or more, and those in two or more contexts."""
    buckets = bucket_count(docs)
    shift = U64(PREFIX - config.filter_bits)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, context = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((context, keys))
            keys, context = keys[order], context[order]
            at = np.flatnonzero(_new((keys, context)))
            many = np.diff(np.append(at, len(keys))) > 1
            keys, context = keys[at], context[at]
            bucket = keys // U64((1 << PREFIX) // buckets + 1)
            cuts = np.flatnonzero(_new((bucket,)))
            rows = [pack(deltas(keys[i:j]), context[i:j], many[i:j]) for i, j in zip(cuts, [*cuts[1:], len(keys)])]
            return pa.RecordBatch.from_pydict({"bucket": bucket[cuts].astype(np.int32), "blob": pa.array(rows, pa.binary())})

        for segments, _ in segmented(source, config):
            a = Anchors(segments, config)
            held.append((a.hash >> U64(64 - PREFIX), a.context() >> U64(24)))
            if sum(len(h[0]) for h in held) > 1_000_000:
                yield out()
                held.clear()
                release()
        if held:
            yield out()
        held.clear()
        release()

    def twice(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x) for b in source for x in b.column("blob").to_pylist()]
        if not parts:
            return
        keys = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        context, many = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = np.lexsort((context, keys))
        keys, context, many = keys[order], context[order], many[order]
        same = keys[1:] == keys[:-1]
        again = np.unique(np.concatenate([keys[1:][same], keys[many]]) >> shift)
        mixed = np.unique(keys[1:][same & (context[1:] != context[:-1])] >> shift)
        yield pa.RecordBatch.from_pydict({"blob": pa.array([pack(deltas(again), deltas(mixed))], pa.binary())})

    dealt = docs.select("doc_id", "text").mapInArrow(count, "bucket int, blob binary")
    found = dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(twice, "blob binary")
    filters = [np.zeros(1 << (config.filter_bits - 3), dtype=np.uint8) for _ in range(2)]
    # At most 2 x 2**filter_bits bits reach the driver, one bucket's at a time.
    for row in found.toLocalIterator():
        for bitmap, part in zip(filters, unpack(row["blob"])):
            bits = np.cumsum(part, dtype=U64)
            np.bitwise_or.at(bitmap, (bits >> U64(3)).astype(np.int64), np.left_shift(1, (bits & U64(7)).astype(np.uint8)).astype(np.uint8))
    return filters[0], filters[1]


def _send(filters, config: RepeatConfig, buckets: int):
    """Runs of windows with repeated anchors, to buckets: a hash of the context where the anchor has but one, else its bytes."""
    shift = U64(64 - config.filter_bits)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, several = filters.value
        held: list = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            mixed, bucket, whole, doc, dig, start, count, begin = (np.concatenate([h[i] for h in held]) for i in range(8))
            data = b"".join([h[8] for h in held])
            begin = np.where(mixed, begin + np.repeat(np.cumsum([0] + [len(h[8]) for h in held[:-1]]), [len(h[0]) for h in held]), 0)
            order = np.lexsort((start, dig, doc, whole, mixed, bucket))
            order = order[_new(tuple(x[order] for x in (whole, doc, dig, start)))]  # a row given twice is one document
            first = _new((bucket[order], mixed[order], whole[order]))
            bucket = bucket[order]
            cuts = np.flatnonzero(_new((bucket,)))
            rows = []
            for i, j in zip(cuts, [*cuts[1:], len(order)]):
                own, fresh = order[i:j], first[i:j]
                kinds = own[fresh & ~mixed[own]], own[~fresh], own[fresh & mixed[own]]
                kinds = [k[np.lexsort((start[k], dig[k], doc[k]))] for k in kinds]
                cols = [x for k in kinds for x in (doc[k], dig[k], start[k], count[k])]
                sent = kinds[2]
                text = b"".join([data[b : b + n] for b, n in zip(begin[sent].tolist(), (count[sent] + (config.length - 1)).tolist())])
                rows.append(pack(*cols, whole[kinds[0]], np.frombuffer(text, dtype=np.uint8)))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cuts].astype(np.int32)), "blob": pa.array(rows, pa.binary())})

        for segments, places in segmented(source, config):
            a = Anchors(segments, config)
            slot = (a.hash >> shift).astype(np.int64)
            bit = (slot & 7).astype(np.uint8)
            hit = np.flatnonzero((repeated[slot >> 3] >> bit) & 1)
            if not len(hit):
                continue
            mixed = ((several[slot[hit] >> 3] >> bit[hit]) & 1).astype(bool)
            start, count, segment = a.start[hit], a.count[hit], a.segment[hit]
            whole = a.context()[hit]
            raw = a.data.tobytes()
            lengths = np.where(mixed, count + (config.length - 1), 0)
            begin = np.cumsum(lengths) - lengths
            data = b"".join([raw[i : i + n] for i, n in zip(start[mixed].tolist(), lengths[mixed].tolist())])
            base = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
            origin = np.array([(p[0], p[1], p[2]) for p in places], dtype=np.int64).reshape(-1, 3)[segment]
            bucket = (np.where(mixed, mix(a.hash[hit]), whole) >> U64(7)) % U64(buckets)
            held.append((mixed, bucket, whole, origin[:, 0], origin[:, 1].astype(np.int32), origin[:, 2] + start - base[segment], count.astype(np.int32), begin, data))
            size += len(data) + 40 * len(hit)
            if size >= config.hold:
                yield from out()
                held, size = [], 0
                release()
        if held:
            yield from out()
        held = []
        release()

    return run


def _meet(config: RepeatConfig, buckets: int):
    """Spans of repeated windows of a bucket, packed by the bucket of their document."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x) for b in source for x in b.column("blob").to_pylist()]
        if not parts:
            return
        spans = []
        doc, dig, start, count, whole = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 12))
        order = np.lexsort((start, dig, doc, whole))
        order = order[_new(tuple(x[order] for x in (whole, doc, dig, start)))]
        later = order[~_new((whole[order],))]
        spans.append((doc[later], dig[later], start[later], count[later].astype(np.int64) + config.length - 1))
        doc, dig, start, count = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6, 7))
        spans.append((doc, dig, start, count.astype(np.int64) + config.length - 1))
        doc, dig, start, count, data = (np.concatenate([p[i] for p in parts]) for i in (8, 9, 10, 11, 13))
        del parts
        if len(doc):
            lengths = count.astype(np.int64) + (config.length - 1)
            begin = np.cumsum(lengths) - lengths
            by_place = np.lexsort((start, dig, doc))
            by_place = by_place[_new((doc[by_place], dig[by_place], start[by_place]))]
            windows = count[by_place].astype(np.int64)
            ends = np.cumsum(windows)
            row = np.repeat(np.arange(len(windows)), windows)
            inner = np.arange(ends[-1]) - np.repeat(ends - windows, windows)
            value = rolling(data, config.length)[begin[by_place][row] + inner]
            order = np.argsort(value, kind="stable")
            again = np.zeros(len(value), dtype=bool)
            again[order[1:]] = value[order][1:] == value[order][:-1]
            opens = np.flatnonzero(again & (np.concatenate([[True], ~again[:-1]]) | (inner == 0)))
            closes = np.flatnonzero(again & np.concatenate([~again[1:] | (inner[1:] == 0), [True]]))
            r = by_place[row[opens]]
            spans.append((doc[r], dig[r], start[r] + inner[opens], inner[closes] - inner[opens] + config.length))
        doc, dig, start, n = (np.concatenate(x) for x in zip(*spans))
        if not len(doc):
            return
        home = (mix(doc.view(U64)) % U64(buckets)).astype(np.int64)
        order = np.lexsort((start, dig, doc, home))
        doc, dig, start, n, home = doc[order], dig[order], start[order], n[order], home[order]
        cuts = np.flatnonzero(_new((home,)))
        rows = [pack(doc[i:j], dig[i:j], start[i:j], n[i:j].astype(np.int32)) for i, j in zip(cuts, [*cuts[1:], len(doc)])]
        release()
        yield pa.RecordBatch.from_pydict({"home": pa.array(home[cuts].astype(np.int32)), "blob": pa.array(rows, pa.binary())})

    return run


def _merge(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def removed_spans(docs: DataFrame, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """doc_id, text and spans (array of struct lo, hi: the maximal removed byte runs) of every document."""
    spark = docs.sparkSession
    buckets = bucket_count(docs) * config.spread
    filters = spark.sparkContext.broadcast(repeated_anchors(docs, config))
    sent = docs.select("doc_id", "text").mapInArrow(_send(filters, config, buckets), "bucket int, blob binary")
    spans = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_meet(config, buckets), "home int, blob binary")
    least = -(1 << 63)

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            ids = np.array([least if x is None else x for x in b.column("doc_id").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((mix(ids.view(U64)) % U64(buckets)).astype(np.int32)), b.column("doc_id").cast(pa.int64()), b.column("text")], names=["home", "doc_id", "text"])

    def cut(rows: pa.Table, blobs: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in blobs.column("blob").to_pylist()]
        found: dict = {}
        if parts:
            d, g, lo, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order = np.lexsort((lo, g, d))
            d, g, lo, hi = d[order], g[order], lo[order], (lo + n)[order]
            cuts = np.flatnonzero((np.diff(d, prepend=d[0] - 1 if d[0] > least else d[0] + 1) != 0) | (np.diff(g, prepend=g[0]) != 0))
            for i, j in zip(cuts, [*cuts[1:], len(d)]):
                found[int(d[i]), int(g[i])] = _merge(lo[i:j], hi[i:j])
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist()
        release()
        spans = [found.get((least if i is None else i, text_digest(t)), []) if t is not None else [] for i, t in zip(ids, texts)]
        return pa.table({"doc_id": rows.column("doc_id"), "text": rows.column("text"), "spans": pa.array([[{"lo": a, "hi": b} for a, b in s] for s in spans], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))})

    placed = docs.select("doc_id", "text").mapInArrow(place, "home int, doc_id bigint, text string")
    return placed.groupBy("home").cogroup(spans.groupBy("home")).applyInArrow(cut, "doc_id bigint, text string, spans array<struct<lo:bigint,hi:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of documents with spans."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows = []
            for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                text = text or b""
                h, at = hashlib.sha256(), 0
                for s in spans:
                    h.update(text[at : s["lo"]])
                    at = s["hi"]
                h.update(text[at:])
                rows.append((len(text), sum(s["hi"] - s["lo"] for s in spans), len(spans), h.hexdigest()))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def repeat_dedup(docs: DataFrame, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    return digests(removed_spans(docs, config))


def repeat_sql(width: int = 100) -> str:
    """The result for documents with unique doc_ids, by every window of ``width`` bytes, for DuckDB."""
    step = 1000
    return f"""
WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
c AS (SELECT doc_id, k * {step} AS base, substring(h, k * {2 * step} + 1, {2 * (step + width - 1)}) AS piece FROM (SELECT doc_id, h, unnest(range(0, length(h) // {2 * step} + 1)) AS k FROM h)),
v AS (SELECT doc_id, base + j AS i, md5(substring(piece, 2 * j + 1, {2 * width})) AS m FROM (SELECT *, unnest(range(0, least({step}, length(piece) // 2 - {width - 1}))) AS j FROM c)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS nth FROM v) WHERE nth > 1),
o AS (SELECT *, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{2 * width}) > {width} AS opens FROM f),
g AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
s AS (SELECT doc_id, run, min(i) AS lo, max(i) + {width} AS hi FROM g GROUP BY doc_id, run),
p AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
k AS (SELECT p.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substring(h.h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substring(any_value(h.h), 2 * max(hi) + 1) AS kept
      FROM p JOIN h ON p.doc_id = h.doc_id GROUP BY p.doc_id)
SELECT h.doc_id, length(h.h) // 2 AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept, h.h))) AS kept_sha256
FROM h LEFT JOIN k ON h.doc_id = k.doc_id"""
