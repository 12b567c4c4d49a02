"""Vectorised text primitives shared by the operators: tokens, hashes, packed blobs and batch plumbing.

Words are maximal runs of bytes other than space and 0x09-0x0D, optionally with A-Z folded to lower case.
A word's identity is a 64-bit hash of its bytes, computed for all words of a batch at once.
"""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_STEP = U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=U64)
    x = x + _STEP
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POW, _INV = _powers(_BASE, _SPAN), _powers(_INVERSE, _SPAN)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of data[start:end] for sorted, non-overlapping slices; equal bytes give equal hashes."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _SPAN, "right")))
        hi = int(ends[j - 1])
        power, inverse = (_POW, _INV) if hi - lo <= _SPAN else (_powers(_BASE, hi - lo), _powers(_INVERSE, hi - lo))
        total = np.empty(hi - lo + 1, dtype=U64)
        total[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], dtype=U64, out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
        i = j
    return out


class Words:
    """All words of a list of texts: hash, start and end of each, and the first word of each text."""

    def __init__(self, texts: list[bytes | None], lower: bool, hashes: bool = True):
        data = b"\n".join([x or b"" for x in texts]) + b"\n"
        self.raw = data
        self.data = np.frombuffer(data.lower() if lower else data, dtype=np.uint8)
        gap = SPACE[self.data]
        before = np.empty_like(gap)
        before[0], before[1:] = True, gap[:-1]
        self.starts, self.ends = np.flatnonzero(before & ~gap), np.flatnonzero(gap & ~before)
        lengths = np.fromiter((len(x or b"") + 1 for x in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, self.text_start)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hashes = slice_hashes(self.data, self.starts, self.ends) if hashes else None


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text and their first offsets; a text of fewer words has one, of all it has."""
    counts = np.diff(first)
    n = len(hashes)
    whole = np.zeros(n, dtype=U64)
    for j in range(k):
        if n > j:
            whole[: n - j] = mix(whole[: n - j] * U64(_BASE) + hashes[j:] + U64(j + 1))
    left = np.repeat(counts, counts) - (np.arange(n) - np.repeat(first[:-1], counts))
    keep = left >= k
    short = np.flatnonzero((counts > 0) & (counts < k))
    values = {}
    for d in short:
        h = np.zeros(1, dtype=U64)
        for j in range(counts[d]):
            h = mix(h * U64(_BASE) + hashes[first[d] + j] + U64(j + 1 + 1000 * counts[d]))
        values[d] = h[0]
        keep[first[d]] = True
    out = whole.copy()
    for d, h in values.items():
        out[first[d]] = h
    per = np.zeros(len(counts) + 1, dtype=np.int64)
    per[1:] = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return out[keep], np.cumsum(per)


def unique_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text's slice, and the new offsets."""
    sets = [np.unique(values[first[i] : first[i + 1]]) for i in range(len(first) - 1)]
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int64)
    return np.concatenate(sets) if sets else values[:0], ends


def crc32(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; 8-byte arrays are stored by byte plane, which suits sorted keys."""
    parts = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 and len(a) else a.tobytes()
        kind = a.dtype.str.encode()
        parts += [len(kind).to_bytes(1, "little"), kind, len(a).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 2
    for _ in range(int.from_bytes(raw[:2], "little")):
        k = raw[at]
        kind = np.dtype(raw[at + 1 : at + 1 + k].decode())
        n = int.from_bytes(raw[at + 1 + k : at + 9 + k], "little")
        at += 9 + k
        size = n * kind.itemsize
        a = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at)
        out.append(np.ascontiguousarray(a.reshape(kind.itemsize, n).T).view(kind).reshape(n) if kind.itemsize > 1 and n else a.view(kind))
        at += size
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, which pack better than the keys."""
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def batches(source: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches whose texts hold about ``limit`` bytes, with the texts as bytes (null: empty)."""
    for batch in source:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        at, total = 0, 0
        for i, x in enumerate(texts):
            if i > at and (total + len(x) > limit or i - at >= rows):
                yield batch.slice(at, i - at), texts[at:i]
                at, total = i, 0
            total += len(x)
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_count(source: DataFrame, each: int = 32 << 20) -> int:
    """Tasks for what is gathered from ``source``: one for ``each`` bytes of its files, and no fewer than shuffles have."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(1, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(-(-size // each), 1 << 20)) if size < 1 << 60 else least


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; one is set only where there is none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_dir = spark.sparkContext.getCheckpointDir()
        named = set_dir or "/tmp/checkpoints"
        if not set_dir:
            spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends here and executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


_written: dict[str, SparkSession] = {}


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no plan reads any more."""
    for df in tables:
        _delete(df.stored_path)


def stored_tables() -> set[str]:
    return set(_written)


def discard_paths(paths: set[str]) -> None:
    for path in paths & set(_written):
        _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended
        return


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs whose plans are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard_stored() -> None:
    """Delete the tables of finished queries."""
    discard_paths(set(_written))


atexit.register(discard_stored)
