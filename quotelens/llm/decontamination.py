"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

1. Every word n-gram of a test item is a seed. One pass over the corpus counts the documents that hold each seed; an item
   keeps the seeds at or below its own ``rare`` quantile of those counts. The rank is within the item, so an item that
   has leaked into very many documents keeps its seeds.
2. A second pass joins passages to items by the kept seeds, and aligns the item with the words around each cluster of
   seed hits, by local alignment over words, for all pairs of a batch at once. The score is the best alignment's share
   of a full match, so edited and partly paraphrased copies score below 1 in proportion.

Items are taken in blocks of at most ``block_words`` words, which bounds what is broadcast; every block sees all
documents. Documents are never shuffled.

Defined cases: null and empty texts, and items without words, match nothing; an item of fewer than ``k`` words is its own
seed; words are compared with A-Z folded and ASCII punctuation ignored; repeated items and repeated documents are
reported each; other columns are ignored, whatever their names; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import U64, Words, _BASE, batches, mix

_PUNCT = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


@dataclass(frozen=True)
class LeakConfig:
    k: int = 3  #: words in a seed
    rare: float = 0.75  #: quantile of an item's seed counts up to which seeds are kept
    least: float = 0.5  #: score from which a passage is a leak
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    slack: int = 8  #: words looked at beyond the item's place on either side
    block_words: int = 2_000_000  #: words of test items that are broadcast at once


def plain(texts: list[bytes]) -> Words:
    return Words([t.translate(_PUNCT) for t in texts], lower=True)


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs within a text and their first words."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0], np.zeros(0, dtype=np.int64)
    out = np.full(m, n, dtype=U64)
    for j in range(n):
        out = mix(out * U64(_BASE) + h[j : j + m])
    own = np.flatnonzero(doc[n - 1 : n - 1 + m] == doc[:m])
    return out[own], own


@dataclass
class Items:
    """A block of test items: ids, words, and seeds (sorted hashes with the item and offset of each occurrence)."""

    ids: list
    words: list[np.ndarray]
    config: LeakConfig
    lengths: list[int] = field(default_factory=list)
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]], config: LeakConfig) -> Items:
        w = plain([t for _, t in rows])
        out = cls([i for i, _ in rows], [w.hashes[w.first[i] : w.first[i + 1]] for i in range(len(rows))], config)
        out.lengths = sorted({min(config.k, len(x)) for x in out.words if len(x)})
        parts = []
        for n in out.lengths:
            h, at = grams(w.hashes, w.doc, n)
            use = (w.counts[w.doc[at]] >= config.k) if n == config.k else w.counts[w.doc[at]] == n
            parts.append((h[use], w.doc[at[use]], at[use] - w.first[w.doc[at[use]]]))
        if parts:
            seeds, item, offset = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(seeds, kind="stable")
            out.seeds, out.item, out.offset = seeds[order], item[order], offset[order]
        out.index()
        return out

    def index(self) -> None:
        self.keys, self.begin = np.unique(self.seeds, return_index=True)
        self.end = np.append(self.begin[1:], len(self.seeds))
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[(self.keys >> U64(42)).astype(np.int64)] = True

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places (first word) and key numbers of the seeds in a batch."""
        places, keys = [], []
        for n in self.lengths:
            h, at = grams(w.hashes, w.doc, n)
            maybe = np.flatnonzero(self.sieve[(h >> U64(42)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            found = self.keys[slot] == h[maybe]
            places.append(at[maybe[found]])
            keys.append(slot[found])
        return (np.concatenate(places), np.concatenate(keys)) if places else (np.zeros(0, int), np.zeros(0, int))

    def rarest(self, seen: dict[int, int]) -> Items:
        """The same items with each one's rare seeds only."""
        count = np.array([seen.get(int(k), 0) for k in range(len(self.keys))], dtype=np.int64)
        own = count[np.searchsorted(self.keys, self.seeds)]
        order = np.lexsort((own, self.item))
        bounds = np.searchsorted(self.item[order], np.arange(len(self.ids) + 1))
        limit = np.zeros(len(self.ids), dtype=np.int64)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b > a:
                limit[i] = own[order[a + int((b - a - 1) * self.config.rare)]]
        keep = own <= limit[self.item]
        out = Items(self.ids, self.words, self.config, self.lengths, self.seeds[keep], self.item[keep], self.offset[keep])
        out.index()
        return out


def align(pairs: list[tuple[np.ndarray, np.ndarray]], config: LeakConfig) -> list[tuple[int, int]]:
    """Best local alignment score and end (in the second sequence) of each pair, all pairs row by row together."""
    m, n = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a, b = np.zeros((len(pairs), m), dtype=U64), np.ones((len(pairs), n), dtype=U64)
    inside = np.zeros((len(pairs), m), dtype=bool)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], b[i, : len(y)], inside[i, : len(x)] = x, y, True
    step = -config.gap * np.arange(n, dtype=np.int32)
    row = np.zeros((len(pairs), n), dtype=np.int32)
    best, end = np.zeros(len(pairs), dtype=np.int32), np.zeros(len(pairs), dtype=np.int64)
    for i in range(m):
        score = np.where((b == a[:, i : i + 1]) & inside[:, i : i + 1], config.match, config.mismatch).astype(np.int32)
        score[:, 1:] += row[:, :-1]
        top = np.maximum(np.maximum(score, row + config.gap), 0)
        row = np.maximum.accumulate(top + step, axis=1) - step
        at = row.argmax(axis=1)
        value = row[np.arange(len(pairs)), at]
        better = value > best
        best[better], end[better] = value[better], at[better] + 1
    return list(zip(best.tolist(), end.tolist()))


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], config: LeakConfig) -> list[tuple[int, int]]:
    """``align`` for any number of pairs, those of like size together and few enough to bound memory."""
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    out: list = [None] * len(pairs)
    at = 0
    while at < len(order):
        end, width = at + 1, len(pairs[order[at]][1])
        while end < len(order) and end - at < 512 and len(pairs[order[end]][1]) <= max(64, 2 * width) and (end - at) * len(pairs[order[end]][1]) < 1 << 20:
            end += 1
        for i, r in zip(order[at:end], align([pairs[i] for i in order[at:end]], config)):
            out[i] = r
        at = end
    return out


def leaks(w: Words, items: Items) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end word) of the best passage of each leaked item in each text of a batch."""
    config = items.config
    place, key = items.hits(w)
    if not len(place):
        return []
    many = items.end[key] - items.begin[key]
    at = np.repeat(items.begin[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    place = np.repeat(place, many)
    item, doc = items.item[at], w.doc[place]
    origin = place - items.offset[at]
    order = np.lexsort((origin, item, doc))
    item, doc, origin = item[order], doc[order], origin[order]
    size = np.array([len(x) for x in items.words], dtype=np.int64)
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(origin) > size[item[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    jobs, pairs = [], []
    for f, t in zip(first, last):
        i, d = int(item[f]), int(doc[f])
        lo = max(int(w.first[d]), int(origin[f]) - config.slack)
        hi = min(int(w.first[d + 1]), int(origin[t]) + len(items.words[i]) + config.slack)
        jobs.append((d, i, lo))
        pairs.append((items.words[i], w.hashes[lo:hi]))
    best: dict[tuple[int, int], tuple] = {}
    for (d, i, lo), pair, (score, end) in zip(jobs, pairs, aligned(pairs, config)):
        share = score / (config.match * len(items.words[i]))
        if share >= config.least and share > best.get((d, i), (0,))[0]:
            best[d, i] = (share, lo, end, pair)
    found = list(best.items())
    if not found:
        return []
    back = aligned([(p[0][::-1], p[1][:end][::-1]) for _, (_, _, end, p) in found], config)
    return [(d, i, share, lo + end - b - int(w.first[d]), lo + end - int(w.first[d])) for ((d, i), (share, lo, end, _)), (_, b) in zip(found, back)]


def blocks(benchmark: DataFrame, config: LeakConfig) -> Iterator[Items]:
    """Test items, a bounded block at a time."""
    rows, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        text = (r["text"] or "").encode()
        rows.append((r["item_id"], text))
        held += len(text) // 2 + 1
        if held >= config.block_words:
            yield Items.of(rows, config)
            rows, held = [], 0
    if rows:
        yield Items.of(rows, config)


def rare_blocks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig) -> Iterator[Items]:
    """Blocks with the seeds that are rare in ``docs``."""
    context = docs.sparkSession.sparkContext
    for items in blocks(benchmark, config):
        if not len(items.keys):
            continue
        shared = context.broadcast(items)

        def count(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            seen = np.zeros(len(own.keys), dtype=np.int64)
            for _, texts in batches(source, "text"):
                w = plain(texts)
                place, key = own.hits(w)
                both = np.unique(w.doc[place] * len(own.keys) + key)
                np.add.at(seen, both % len(own.keys), 1)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({"key": at, "n": seen[at]})

        counted = docs.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        # One row per seed of the block at most.
        yield items.rarest({r["key"]: r["n"] for r in counted.toLocalIterator()})


def decontaminate(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """doc_id, item_id, score, start_word and end_word (in the document) of every leaked passage."""
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, start_word bigint, end_word bigint"
    out = spark.createDataFrame([], schema)
    for items in rare_blocks(docs, benchmark, config):
        shared = spark.sparkContext.broadcast(items)

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch, texts in batches(source, "text"):
                if found := leaks(plain(texts), own):
                    d, i, score, lo, hi = zip(*found)
                    ids = pa.array([own.ids[k] for k in i], pa.from_numpy_dtype(np.int64) if kinds[1] in ("bigint", "int") else pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), ids, pa.array(score, pa.float64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["doc_id", "item_id", "score", "start_word", "end_word"])

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def leaked_removed(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """``docs`` without the documents that hold a leaked passage."""
    for items in rare_blocks(docs, benchmark, config):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in batches(source, "text"):
                bad = {d for d, *_ in leaks(plain(texts), shared.value)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
