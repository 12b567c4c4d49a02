"""Compression-distance classifiers: two zstandard dictionaries, one per class, and a calibrated score.

Each dictionary holds the strings that are far commoner in labelled texts of its class. A text is cut into windows, each
compressed with both dictionaries; the difference of the two lengths, its distribution over the windows, and the
compressed size of the whole text become a probability by a logistic calibration on labelled texts that the dictionaries
have not seen. Both dictionaries and every window start with one fixed header, so that each window holds a match and
the compressor never falls back to storing it, which would hide small differences.

The fit uses a bounded sample of labelled rows (``per_class`` of each label, by the order of a hash of doc_id); scoring
is a map over whole texts. Held-out rows (crc32 of the doc_id as text, modulo ``folds``, is 0) are never learned from.

Defined cases: null and empty texts are scored as one empty window; rows with null labels or ids teach nothing; with
fewer than two classes the score is the share of label 1, smoothed; repeated rows get equal scores; other columns of the
documents are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = bytes(65 + (i * i * 7 + i * 3) % 26 for i in range(48))
EDGES = b".,!?;:|*#$%&()\"'"


@dataclass(frozen=True)
class CompressionConfig:
    lower: bool = True  #: fold A-Z before compressing
    suffixes: bool = False  #: also learn word endings, where markup sits
    window: int = 60  #: bytes
    per_class: int = 4000  #: bound of the labelled sample, of each label
    lift: float = 0.12  #: least log-likelihood gain of a dictionary string per text of its class
    dictionary: int = 8000  #: most bytes of a dictionary
    folds: int = 5
    threshold: float = 0.5


def strings(text: bytes, config: CompressionConfig) -> set[bytes]:
    """Candidate dictionary strings of a text: its words, their beginnings, and their endings if asked for."""
    out = set()
    if config.suffixes:  # with what is before marks that stand alone
        words = text.split()
        out.update(a[-k:] + b" " + b + b" " for a, b in zip(words, words[1:]) if not b.strip(EDGES) for k in (1, 2, 3))
    for word in set(text.split()):
        bare = word.strip(EDGES)
        if len(bare) >= 3:
            out.add(b" " + bare + b" ")
            out.update(b" " + bare[:k] for k in (4, 5, 6) if len(bare) > k)
        if config.suffixes and (bare != word or not bare):
            out.update(word[-k:] + b" " for k in (1, 2, 3, 4) if len(word) >= k)
            out.add(b" " + word + b" ")
    return out


def windows(text: bytes, width: int) -> list[bytes]:
    """The whole text in pieces of at most ``width`` bytes, cut at spaces where there are any."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + width)
        if end < len(text):
            space = text.rfind(b" ", at + width // 2, end)
            end = space if space > 0 else end
        out.append(text[at:end])
        at = end
    return out or [b""]


def content(own: Counter, other: Counter, n_own: int, n_other: int, config: CompressionConfig) -> bytes:
    """The strings that mark one class, weakest first: the compressor reaches the end of a dictionary most cheaply."""
    least = max(12.0, config.lift * n_own)
    gain = {}
    for s, c in own.items():
        ratio = (c / n_own) / ((other.get(s, 0) + 0.5) / (n_other + 1))
        if c > 4 and ratio > 3 and c * np.log(ratio) >= least:
            gain[s] = c * np.log(ratio)
    out, size = [], 0
    for s in sorted(gain, key=lambda s: (-gain[s], s)):
        if size + len(s) > config.dictionary:
            break
        out.append(s)
        size += len(s)
    return b"".join(reversed(out))


def compressor(text: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters(window_log=14, hash_log=14, chain_log=14, search_log=3, min_match=5, target_length=0, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass
class Model:
    config: CompressionConfig
    one: bytes  #: dictionary content of label 1
    zero: bytes
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def scorer(self) -> Callable[[bytes], float]:
        measure = self.measurer()

        def score(text: bytes) -> float:
            if self.weights is None:
                return self.prior
            x = np.append((measure(text) - self.mean) / self.scale, 1.0)
            return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))

        return score

    def measurer(self) -> Callable[[bytes], np.ndarray]:
        size = max(len(self.one), len(self.zero), 8)
        one, zero = (compressor(b"~" * (size - len(d)) + d + HEADER).compress for d in (self.one, self.zero))
        plain = zstandard.ZstdCompressor(level=3).compress
        config = self.config

        def measure(text: bytes) -> np.ndarray:
            if config.lower:
                text = text.lower()
            parts = [HEADER + w for w in windows(text, config.window)]
            d = np.array([len(zero(w)) - len(one(w)) for w in parts], dtype=float)
            top, low = np.sort(d)[-3:], np.sort(d)[:3]
            ratio = np.log((len(plain(text)) + 1) / (len(text) + 20))
            return np.array([top[-1], top.mean(), np.mean(d >= 2), np.log1p(np.sum(d >= 2)), low[0], np.mean(d <= -2), np.log1p(np.sum(d <= -2)), d.mean(), np.maximum(d - 1, 0).mean(), ratio, ratio * ratio])

        return measure


def fit(rows: list[tuple[bytes, int]], config: CompressionConfig) -> Model:
    """Dictionaries from two thirds of the labelled texts, the calibration from the rest."""
    by = {k: sorted({t for t, y in rows if y == k}) for k in (0, 1)}
    n = sum(1 for _, y in rows if y == 1)
    model = Model(config, b"", b"", (n + 1) / (len(rows) + 2))
    if min(map(len, by.values())) < 6:
        return model
    fold = lambda t: t.lower() if config.lower else t
    counts = {}
    for k, texts in by.items():
        texts[:] = sorted(texts, key=lambda t: zstandard.ZstdCompressor().compress(t)[-4:] + t[:8])
        counts[k] = Counter()
        for t in texts[len(texts) // 3 :]:
            counts[k].update(strings(fold(t), config))
    used = {k: len(t) - len(t) // 3 for k, t in by.items()}
    model.one = content(counts[1], counts[0], used[1], used[0], config)
    model.zero = content(counts[0], counts[1], used[0], used[1], config)
    measure = model.measurer()
    held = [(t, k) for k, texts in by.items() for t in texts[: len(texts) // 3]]
    x = np.array([measure(t) for t, _ in held])
    y = np.array([k for _, k in held], dtype=float)
    share = {k: sum(1 for _, z in rows if z == k) / max(1, sum(1 for _, z in held if z == k)) for k in (0, 1)}
    sample = np.array([share[k] for _, k in held])
    sample /= sample.mean()
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(len(w) - 1, 0.3), 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (sample * (y - p)) - ridge * w
        bend = (x.T * (sample * p * (1 - p))) @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def held_out(config: CompressionConfig) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(config.folds)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str, config: CompressionConfig) -> Model:
    """A model of ``label`` from at most ``per_class`` labelled texts of each class."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(config)).distinct()
    key = F.xxhash64("doc_id")
    ids = None
    total = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    for k in (0, 1):
        part = marked.where(F.col("y") == k).orderBy(key, "doc_id").limit(config.per_class)
        ids = part if ids is None else ids.union(part)
    # At most 2 x per_class ids are broadcast, and as many texts come to the driver.
    found = docs.select("doc_id", "text").join(F.broadcast(ids.withColumnRenamed("doc_id", "marked_id")), F.col("doc_id") == F.col("marked_id"))
    rows = [((r["text"] or "").encode(), r["y"]) for r in found.select("text", "y").toLocalIterator()]
    model = fit(rows, config)
    # Prior shift: the sample may hold classes in other shares than all labelled rows do.
    have = Counter(y for _, y in rows)
    if model.weights is not None and total.get(0) and total.get(1):
        model.weights[-1] += np.log(total[1] / total[0]) - np.log(have[1] / have[0])
        model.prior = (total[1] + 1) / (total[0] + total[1] + 2)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = shared.value.scorer()
        for b in source:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([rate(t or b"") for t in texts], pa.float64())], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(model.config).alias("held_out"), "text")
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= model.config.threshold).cast("int"))


QUALITY = CompressionConfig(lower=False, suffixes=True, threshold=0.3)
TOXICITY = CompressionConfig()


def quality(docs: DataFrame, labels: DataFrame, config: CompressionConfig = QUALITY) -> DataFrame:
    return score(docs, train(docs, labels, "quality", config))


def toxicity(docs: DataFrame, labels: DataFrame, config: CompressionConfig = TOXICITY) -> DataFrame:
    return score(docs, train(docs, labels, "toxic", config))


def rejected_removed(docs: DataFrame, labels: DataFrame, config: CompressionConfig = QUALITY) -> DataFrame:
    """``docs`` without the rows whose text the quality classifier rejects."""
    model = train(docs, labels, "quality", config)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = shared.value.scorer()
        for b in source:
            keep = [rate(t or b"") >= model.config.threshold for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
