"""Katz backoff language model: Good-Turing discounted bigrams and unigrams with exactly normalised backoff weights.

The tokens of a text are its words and one end token; histories are the word before, or the start of the text.

1. Each task packs the bigrams of about ``chunk_tokens`` tokens, once per chunk with the documents they occur in, and deals
   them to partitions by history. Histories that hold more than a fraction of the corpus are dealt by history and word,
   so no history fills one partition. This shuffle is the partitioned table of the model; every later pass reads it again.
2. Each partition sums its training counts. Counts of counts, a few numbers, give the discounts; the word totals of each
   partition go to the words' own partitions, which answer with corpus totals.
3. Each history's backoff weight is the probability that discounting freed over the unigram probability of what was not
   seen after it, so its distribution sums to one. Split histories add up their parts first.
4. Each bigram's probability, by recursion to the unigram where it was not seen, is added to its documents' sums.

Unknown words share one class, which has the probability that discounting freed from the unigrams. If discounting frees
nothing (counts of counts of a small corpus can say so), denominators grow by one.

Words are identified by 56-bit hashes. Defined cases: null text is empty and holds the end token alone; rows with null
doc_id teach and are scored, and are never held out; repeated rows count each time; without training rows every token is
unknown; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import release, trimmed
from .textcore import U64, Words, _BASE, batches, bucket_count, mix, pack, unpack

END, START = U64(1), U64(2)
_MASK = U64((1 << 56) - 1)


@dataclass(frozen=True)
class KatzConfig:
    folds: int = 7  #: documents whose crc32 modulo this is ``held`` teach nothing
    held: int = 2
    cut: int = 5  #: counts above this are not discounted
    chunk_tokens: int = 1_200_000
    spread: int = 2  #: parts of the table for each shuffle partition
    split: int = 16  #: parts of a history that is frequent
    frequent: float = 0.25  #: a history is frequent from this share of a mean partition on


def is_held_out(doc_id, config: KatzConfig) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % config.folds == config.held


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories, words and text numbers of all tokens, the end of each text included."""
    w = Words(texts, lower=True)
    n = len(w.hashes) + len(texts)
    word, history = np.empty(n, dtype=U64), np.empty(n, dtype=U64)
    first = w.first[:-1] + np.arange(len(texts))
    last = first + w.counts
    inner = np.ones(n, dtype=bool)
    inner[last] = False
    word[inner] = w.hashes & _MASK
    word[last] = END
    history[1:] = word[:-1]
    history[first] = START
    return history, word, np.repeat(np.arange(len(texts)), w.counts + 1)


def discounts(n: np.ndarray, config: KatzConfig) -> np.ndarray:
    """Good-Turing discount factors of counts 0..cut from counts of counts; an absolute discount where those give none."""
    k = config.cut
    out = np.ones(k + 1)
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0)


@dataclass
class Unigrams:
    total: int  #: training tokens
    kinds: int  #: distinct training tokens
    d: np.ndarray
    mass: float  #: sum of discounted counts
    config: KatzConfig

    def __post_init__(self):
        self.base = self.total if self.mass < self.total else self.total + 1
        self.unknown = 1 - self.mass / self.base if self.total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / max(self.base, 1), self.unknown)


def _route(history: np.ndarray, word: np.ndarray, frequent: np.ndarray, config: KatzConfig) -> np.ndarray:
    at = np.minimum(np.searchsorted(frequent, history), max(len(frequent) - 1, 0))
    hot = frequent[at] == history if len(frequent) else np.zeros(len(history), dtype=bool)
    return mix(history + np.where(hot, (mix(word) % U64(config.split) + U64(1)) << U64(56), U64(0)))


def frequent_histories(docs: DataFrame, partitions: int, config: KatzConfig) -> np.ndarray:
    """Histories with more than ``frequent`` of a mean partition's tokens; at most partitions / frequent of them."""
    share = config.frequent / partitions

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total, held = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), 0, []

        def merge():
            k, inverse = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            return k, np.bincount(inverse, weights=np.concatenate([counts, np.ones(sum(map(len, held)), dtype=np.int64)]), minlength=len(k)).astype(np.int64)

        for _, texts in batches(source, "text"):
            h, _, _ = tokens(texts)
            total += len(h)
            held.append(h)
            if sum(map(len, held)) > 2_000_000:
                keys, counts = merge()
                held = []
        if total:
            keys, counts = merge()
            # What is frequent in the corpus is as frequent in some task.
            at = np.flatnonzero(counts >= share * total)
            yield pa.RecordBatch.from_pydict({"key": pa.array([0, *keys[at].view(np.int64)], pa.int64()), "n": pa.array([total, *counts[at]], pa.int64())})

    rows = docs.select("text").mapInArrow(trimmed(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    total = rows.where("key = 0").agg(F.sum("n")).first()[0] or 0
    found = rows.where((F.col("key") != 0) & (F.col("n") >= share * total)).select("key")
    return np.sort(np.array([r["key"] for r in found.toLocalIterator()], dtype=np.int64).view(U64))


def _deal(frequent, partitions: int, config: KatzConfig):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        task, seq = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            history, word, doc = (np.concatenate([h[i] for h in held]) for i in range(3))
            ids = [x for h in held for x in h[3]]
            sizes = [(len(h[0]), len(h[3])) for h in held]
            held.clear()
            away = np.array([is_held_out(i, config) for i in ids])
            doc = doc + np.repeat(np.cumsum([0] + [n for _, n in sizes[:-1]]), [n for n, _ in sizes])
            route = _route(history, word, hot, config)
            key = (route & U64(0xFFFFFF0000000000)) | (mix(history * U64(_BASE) + word) >> U64(24))
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order].astype(np.int32)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            history, word, key = history[order][at], word[order][at], key[at]
            many = np.diff(np.append(at, len(doc)))
            home = ((key >> U64(40)) * U64(partitions)) >> U64(24)
            cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
            chunk = (task << 20) + seq
            bits = np.packbits(away)
            homes, blobs = [], []
            for i, j in zip(cuts, [*cuts[1:], len(key)]):
                h = history[i:j]
                new = np.concatenate([[True], h[1:] != h[:-1]])
                homes.append(int(home[i]))
                blobs.append(pack(np.array([chunk, len(ids)], dtype=np.int64), bits, new, h[new], word[i:j], many[i:j].astype(np.int32), doc[at[i] : at[j] if j < len(at) else len(doc)]))
            known = np.array([0 if x is None else x for x in ids], dtype=np.int64)
            null = np.array([x is None for x in ids])
            homes.append(chunk % partitions)
            blobs.append(b"D" + pack(np.array([chunk], dtype=np.int64), known, null, away))
            yield pa.RecordBatch.from_pydict({"home": pa.array(homes, pa.int32()), "blob": pa.array(blobs, pa.binary())})

        for batch, texts in batches(source, "text"):
            held.append((*tokens(texts), batch.column("doc_id").to_pylist()))
            size += len(held[-1][0])
            if size >= config.chunk_tokens:
                yield from out()
                held, size, seq = [], 0, seq + 1
                release()
        if held:
            yield from out()

    return trimmed(run)


class Part:
    """A partition of the bigram table: its chunks' entries, and the distinct bigrams with training counts."""

    def __init__(self, blobs: list[bytes]):
        self.chunks, self.tables = [], []
        h, w, c = [], [], []
        for b in blobs:
            if b[:1] == b"D":
                self.tables.append(b)
                continue
            head, bits, new, hs, word, many, doc = unpack(b)
            away = np.unpackbits(bits, count=int(head[1])).astype(bool)
            ends = np.cumsum(many)
            learnt = np.concatenate([[0], np.cumsum(~away[doc])])
            h.append(hs[np.cumsum(new) - 1])
            w.append(word)
            c.append(learnt[ends] - learnt[ends - many])
            self.chunks.append((int(head[0]), int(head[1]), many, doc))
        if not h:
            self.history = self.word = np.zeros(0, dtype=U64)
            self.count, self.kind = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            self.words, self.slot = self.word, self.kind
            return
        h, w, c = np.concatenate(h), np.concatenate(w), np.concatenate(c)
        # By history first: a history's bigrams end up together.
        key = (mix(h) & U64(0xFFFFFFFF00000000)) | (mix(h * U64(_BASE) + w) >> U64(32))
        order = np.lexsort((w, h)) if len(h) < 1000 else np.argsort(key)
        ho, wo = h[order], w[order]
        new = np.concatenate([[True], (ho[1:] != ho[:-1]) | (wo[1:] != wo[:-1])])
        at = np.flatnonzero(new)
        self.history, self.word = ho[at], wo[at]
        self.count = np.add.reduceat(c[order], at)
        self.kind = np.empty(len(h), dtype=np.int32)
        self.kind[order] = np.cumsum(new, dtype=np.int32) - 1
        del h, w, c, key, order, ho, wo, new, at
        self.words, slot = np.unique(self.word, return_inverse=True)
        self.slot = slot.astype(np.int32)

    def totals(self) -> np.ndarray:
        """Training count in this partition of each distinct word."""
        return np.bincount(self.slot, weights=self.count, minlength=len(self.words)).astype(np.int64)

    def histories(self, p: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct histories, each bigram's history, and sums: counts, discounted counts, unigram probability seen."""
        at, own = np.unique(self.history, return_inverse=True)
        seen = self.count > 0
        add = lambda x: np.bincount(own, weights=x, minlength=len(at))
        return at, own, add(self.count), add(discounted(self.count, d)), add(np.where(seen, p, 0.0))


def _by_partition(records) -> list[bytes]:
    return [bytes(b) for _, b in records]


def katz_scores(docs: DataFrame, config: KatzConfig = KatzConfig()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    context, n = spark.sparkContext, bucket_count(docs) * config.spread
    frequent = context.broadcast(frequent_histories(docs, n, config))
    identity = lambda k: k
    dealt = docs.select("doc_id", "text").mapInArrow(_deal(frequent, n, config), "home int, blob binary")
    # An RDD, because its shuffle files serve each of the passes below; rows are a few packed blobs per task.
    table = dealt.rdd.map(lambda r: (r["home"], bytes(r["blob"]))).partitionBy(n, identity)
    n = table.getNumPartitions()
    most = config.cut + 2

    def ask(part: int, records) -> Iterator[tuple]:
        own = Part(_by_partition(records))
        yield -1, np.bincount(np.minimum(own.count, most), minlength=most + 1)[:most].tobytes()
        total = own.totals()
        release()
        home = (mix(own.words) >> U64(32)) * U64(n) >> U64(32)
        for b in np.unique(home):
            at = np.flatnonzero(home == b)
            yield int(b), pack(np.array([part], dtype=np.int64), own.words[at], total[at])

    def answer(records) -> Iterator[tuple]:
        asked = [unpack(b) for b in _by_partition(records)]
        if not asked:
            return
        keys, inverse = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([a[2] for a in asked]), minlength=len(keys)).astype(np.int64)
        r = np.minimum(total, most)
        yield -1, np.concatenate([np.bincount(r, minlength=most + 1), [total.sum(), (total > 0).sum(), total[total <= config.cut].sum()]]).astype(np.int64).tobytes()
        at = 0
        for a in asked:
            yield int(a[0][0]), pack(a[1], total[inverse[at : at + len(a[1])]])
            at += len(a[1])

    asked = table.mapPartitionsWithIndex(trimmed(ask))
    requests = asked.filter(lambda r: r[0] >= 0).partitionBy(n, identity)
    answered = requests.mapPartitions(trimmed(answer))
    replies = answered.filter(lambda r: r[0] >= 0).partitionBy(n, identity)
    sums = lambda rdd: rdd.filter(lambda r: r[0] < 0).map(lambda r: np.frombuffer(r[1], dtype=np.int64)).treeReduce(np.add)
    if docs.isEmpty():
        return spark.createDataFrame([], _schema(docs))
    d2 = discounts(sums(asked), config)
    u = sums(answered)
    d1 = discounts(u[: most + 1], config)
    small = np.arange(config.cut + 1)
    mass = float((u[: config.cut + 1] * discounted(small, d1)).sum() + u[most + 1] - u[most + 3])
    unigrams = Unigrams(int(u[most + 1]), int(u[most + 2]), d1, mass, config)

    def joined(records, answers):
        own = Part(_by_partition(records))
        got = [unpack(bytes(b)) for _, b in answers]
        words = np.concatenate([g[0] for g in got]) if got else own.words
        total = np.concatenate([g[1] for g in got]) if got else own.totals()
        order = np.argsort(words)
        c = total[order][np.searchsorted(words, own.words, sorter=order)][own.slot] if len(own.words) else own.count
        return own, c

    both = table.glom().zip(replies.glom())
    hot = frequent.value

    def parts(pair) -> Iterator[tuple]:
        own, c = joined(*pair)
        at, _, count, kept, seen = own.histories(unigrams.p(c), d2)
        held = np.flatnonzero(np.isin(at, hot))
        yield from ((int(at[i]), (count[i], kept[i], seen[i])) for i in held)

    # One row per frequent history and part: at most partitions / frequent x split.
    whole = dict(both.flatMap(trimmed(parts)).reduceByKey(lambda a, b: tuple(x + y for x, y in zip(a, b))).collect()) if len(hot) else {}
    keys = np.array(sorted(whole), dtype=U64)
    shared = context.broadcast((keys, np.array([whole[int(k)] for k in keys]).reshape(-1, 3)))

    def evaluate(pair) -> Iterator[tuple]:
        own, c = joined(*pair)
        p1 = unigrams.p(c)
        at, of, count, kept, seen = own.histories(p1, d2)
        keys, rows = shared.value
        if len(keys):
            slot = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
            split = keys[slot] == at
            for column, x in enumerate((count, kept, seen)):
                x[split] = rows[slot[split], column]
        base = np.where(kept < count, count, count + 1)
        alpha = np.where(count > 0, (1 - kept / np.maximum(base, 1)) / np.maximum(1 - seen, 1e-300), 1.0)
        p = np.where(own.count > 0, discounted(own.count, d2) / np.maximum(base, 1)[of], alpha[of] * p1)
        log, plain = np.log10(np.maximum(p, 1e-300)), np.log10((c + 1) / (unigrams.total + unigrams.kinds + 1))
        start, kind = 0, None
        for chunk, size, many, doc in own.chunks:
            kind = np.repeat(own.kind[start : start + len(many)], many)
            start += len(many)
            sums = [np.bincount(doc, minlength=size), np.bincount(doc, weights=c[kind] > 0, minlength=size), np.bincount(doc, weights=plain[kind], minlength=size), np.bincount(doc, weights=log[kind], minlength=size)]
            used = np.flatnonzero(sums[0])
            yield chunk, pack(used.astype(np.int32), sums[0][used].astype(np.int32), sums[1][used].astype(np.int32), sums[2][used], sums[3][used])
        del p, log, plain, kind
        release()
        for b in own.tables:
            yield int(unpack(b[1:])[0][0]), b

    total = unigrams.total
    schema = _schema(docs)

    def gather(group: pa.Table) -> pa.Table:
        blobs = group.column("blob").to_pylist()
        ids, null, away = next(unpack(b[1:]) for b in blobs if b[:1] == b"D")[1:]
        out = [np.zeros(len(ids), dtype=t) for t in (np.int64, np.int64, float, float)]
        for b in blobs:
            if b[:1] != b"D":
                used, *sums = unpack(b)
                for x, s in zip(out, sums):
                    x[used] += s
        kind = pa.int32() if "int," in schema.split("held_out")[0].replace("bigint,", "") else pa.int64()
        return pa.table({"doc_id": pa.array(ids, mask=null).cast(kind), "held_out": pa.array(away), "n_tokens": out[0], "n_known": out[1], "train_tokens": np.full(len(ids), total, dtype=np.int64), "base_score": out[2], "score": out[3]})

    rows = spark.createDataFrame(both.flatMap(trimmed(evaluate)), "chunk bigint, blob binary")
    return rows.groupBy("chunk").applyInArrow(gather, schema)


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
