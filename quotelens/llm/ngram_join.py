"""N-gram Jaccard join: exact links between documents whose shingle sets are near in the Jaccard metric.

1. Documents with equal shingle sets are one node (a 64-bit digest of the set).
2. Top-level regions. Unrelated texts are all at distance 1 from each other, so triangle-inequality windows around
   pivots of the whole corpus would replicate every document to every region. Nodes therefore first meet by partition
   signatures: the shingle space is dealt into more parts than two linked sets can differ in, so linked nodes agree in a
   known least number of parts. Pairs that share fewer signatures than that, or whose sizes or profiles (a lower bound of
   the distance) rule a link out, are dropped; the rest make candidate regions (components).
3. Pivot join, recursive. A region that does not fit a task is dealt out by pivots: every node learns its distance to
   each pivot, nodes linked to a pivot are joined to it, and each node goes to its nearest pivot's Voronoi region and, by
   the triangle inequality, to every region whose pivot is at most twice the link distance further. Only keys are dealt.
   What the links so far have already joined needs no comparison: a region keeps the nodes outside its largest
   component and, of that component, those within their windows. The regions are then joined in the same way, and
   inside a task every next pivot prunes partners by the windows of the pivots before it. A region that pivots do not
   thin out is joined as blocks of the nodes outside its largest component against blocks of all.
4. Components of the links give each document its class.

Exact up to 64-bit hash collisions. Defined cases: a null or wordless text has an empty set and no links; fewer words
than ``k`` make one shingle; repeated rows and equal sets share a component; rows of a null doc_id take part, and the
id of a component is its least non-null doc_id; other columns are ignored, whatever their names; a long text is one set
like any other, and regions are bounded by shingles as well as rows; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import release
from .textcore import U64, Words, batches, bucket_count, deltas, discard, free_shuffles, mix, pack, shingles, stored, unique_sets, unpack


@dataclass(frozen=True)
class JoinConfig:
    k: int = 3  #: words in a shingle
    percent: int = 90  #: two sets link when 100 * intersection >= percent * union
    region_rows: int = 3000  #: larger regions are dealt out by pivots
    region_items: int = 4_000_000  #: the same bound in shingles
    pivots: int = 16
    levels: int = 6  #: levels of pivots at most; what is still too large then is joined by blocks
    few: int = 32  #: groups of one signature up to this size are compared pair by pair, larger ones up to region_rows by pivots
    sample: int = 8000  #: documents in which common shingles are looked for
    round_pairs: int = 8_000_000  #: candidate pairs are judged so many at a time, since they are on disk meanwhile,
    pairs_a_node: int = 8  #: or so many for each node, if that is more


def classes(config: JoinConfig, most: int) -> list[tuple[int, int, int, int]]:
    """Size classes (least, most, greatest symmetric difference, parts) that cover sizes up to ``most``."""
    out, lo = [], 1
    t = config.percent
    while lo <= most:
        hi = max(lo, lo * 10000 // (t * t))
        differ = 2 * hi * (100 - t) // (100 + t)
        # The smallest sets of a class fill more than ``differ`` parts only if there are some to spare, else their signatures
        # are single shingles, which meet by chance the more often the more documents there are.
        out.append((lo, hi, differ, differ + 2 + differ // (12 if t >= 90 else 4)))
        lo = hi + 1
    return out


def signatures(items: np.ndarray, config: JoinConfig, table: list[tuple[int, int, int, int]], common: np.ndarray) -> tuple[np.ndarray, int, int, int]:
    """The part signatures of one set, for its own size class and the next one that larger partners may be in; the own
    class; and how many signatures a linked partner shares at least if the larger set is of the own or the next class.

    Linked sets agree in at least parts - differ parts. Parts that are empty or hold only ``common`` shingles say nothing and
    are left out; a set with so many of them that all agreed parts might be such gives the shingles of its prefix, rarest
    first, of which linked sets share at least one. What is left out depends on a part's content alone, so both sets of
    a pair leave out the same.
    """
    n, t = len(items), config.percent
    out: list[np.ndarray] = []
    own, needs = -1, [0, -1]
    known = common[np.minimum(np.searchsorted(common, items), len(common) - 1)] == items if len(common) else np.zeros(n, dtype=bool)
    fallback = False
    for c, (lo, hi, differ, parts) in enumerate(table):
        if hi < n:
            continue
        own = c if own < 0 else own
        if lo > max(n, 100 * n // t):
            break
        if not differ:
            needs[min(c - own, 1)] = 0
            continue
        h = mix(items + U64(c + 1))
        part = ((h >> U64(32)) * U64(parts)) >> U64(32)
        total, telling = np.zeros(parts, dtype=U64), np.zeros(parts, dtype=bool)
        np.add.at(total, part, h)
        telling[part[~known].astype(np.int64)] = True
        filled = np.flatnonzero(telling)
        out.append(mix(mix(total[filled] + U64(c)) + filled.astype(U64)))
        fallback |= len(filled) <= differ
        if c - own < 2:
            needs[c - own] = max(0, len(filled) - differ)
    if fallback:
        rarest = items[np.lexsort((items, known))]
        out.append(mix(rarest[: n - -(-t * n // 100) + 1] + U64(0x5BD1E995)))
    # A set that no set of the next class can be linked to needs as much there as in its own.
    return (np.concatenate(out) if out else items[:0]), own, needs[0], needs[1] if needs[1] >= 0 else needs[0]


def common_shingles(docs: DataFrame, config: JoinConfig) -> np.ndarray:
    """Shingles in three or more of about ``sample`` documents. They only steer which parts are compared, never results."""
    total = docs.count()
    step = -(-total // config.sample)
    picked = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(step, 1))) == 0)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [s for _, texts in batches(source, "text") for s in shingle_sets(texts, config.k)]
        if sets:
            keys, seen = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "n": seen})

    many = picked.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 3").select("key")
    # Bounded by the sample: at most a third of its shingles.
    return np.sort(np.array([r["key"] for r in many.toLocalIterator()], dtype=np.int64).view(U64))


def digest(items: np.ndarray) -> int:
    return int(mix(np.array([mix(items).sum(dtype=U64) ^ U64(len(items))], dtype=U64))[0].view(np.int64)) if len(items) else 0


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    w = Words(texts, lower=True)
    v, first = unique_sets(*shingles(w.hashes, w.first, k))
    return [v[first[i] : first[i + 1]] for i in range(len(texts))]


BINS = 64


def profile(items: np.ndarray) -> bytes:
    """Shingles per bin, at least one bin for eight: the distance of two profiles, the finer one folded to the width of the
    other, is at most the symmetric difference of the sets."""
    bits = max(6, (max(len(items) - 1, 0) // 8).bit_length())
    return np.minimum(np.bincount((mix(items) >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).sum(axis=1, dtype=np.int32)


def nodes(docs: DataFrame, config: JoinConfig, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry``, n_shingles, node (null for an empty set) and profile of every document."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source, "text"):
            sets = shingle_sets(texts, config.k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()), pa.array([profile(s) for s in sets], pa.binary())], names=[*own, "n_shingles", "node", "profile"])

    own = ("doc_id", *carry)
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in own)
    return docs.select(*own, "text").mapInArrow(run, f"{kinds}n_shingles bigint, node bigint, profile binary")


def candidates(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """What signatures say of nodes, as (a, b, kind, n, m) with ``n`` a number of signatures: kind 0, the nodes a and b share n
    in small groups; 1, node a is in the middling group b; 2, node a is linked to the head b of a large group; 16 + c, node a
    of size class c has b shingles and shares n signatures with a linked partner at least, m if that is of the next class."""
    buckets = bucket_count(docs)
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, config))
    flush = 1 << 20

    def deal(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, common = classes(config, 1 << 40), shared.value
        held: list = []
        facts: list = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            sig, node = (np.concatenate(x) for x in zip(*held))
            fact = np.array(facts, dtype=np.int64).reshape(-1, 5)
            held.clear()
            facts.clear()
            sig >>= U64(16)  # 48 bits: what meets by chance is told apart below
            bucket, home = ((sig >> U64(4)) % U64(buckets)).astype(np.int64), (fact[:, 0].view(U64) % U64(buckets)).astype(np.int64)
            order = np.lexsort((node, sig, bucket))
            sig, node, bucket = sig[order], node[order], bucket[order]
            new = np.ones(len(sig), dtype=bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, bucket = sig[new], node[new], bucket[new]
            order = np.argsort(home, kind="stable")
            fact, home = fact[order], home[order]
            at = np.unique(np.concatenate([bucket, home]))
            cuts = np.searchsorted(bucket, at), np.searchsorted(bucket, at, "right"), np.searchsorted(home, at), np.searchsorted(home, at, "right")
            blobs = [pack(deltas(sig[i:j]), node[i:j], *fact[k:m].T) for i, j, k, m in zip(*cuts)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "blob": pa.array(blobs, pa.binary())})

        for _, texts in batches(source, "text"):
            for s in shingle_sets(texts, config.k):
                if not len(s):
                    continue
                sig, own, least, next_least = signatures(s, config, table, common)
                if len(sig):
                    key = digest(s)
                    held.append((sig, np.full(len(sig), key, dtype=np.int64)))
                    facts.append((key, len(s), own, least, next_least))
                    size += len(sig)
                    if size >= flush:
                        yield from out()
                        size = 0
                        release()
        if held:
            yield from out()
        release()

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x) for b in source for x in b.column("blob").to_pylist()]
        if not parts:
            return
        sig = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        node = np.concatenate([p[1] for p in parts])
        fact = [np.concatenate([p[k] for p in parts]) for k in range(2, 7)]
        del parts
        yield pa.RecordBatch.from_arrays([pa.array(fact[0]), pa.array(fact[1]), *(pa.array(x.astype(np.int32)) for x in (fact[2] + 16, fact[3], fact[4]))], names=names)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        new = np.ones(len(sig), dtype=bool)
        new[1:] = sig[1:] != sig[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(sig)))
        met = np.repeat(size > 1, size)
        sig, node, size = sig[met], node[met], size[size > 1]
        at = np.cumsum(size) - size
        first, left = np.repeat(at, size), np.repeat(at + size, size) - np.arange(len(sig))
        small = np.repeat(size, size) <= config.few
        large = np.repeat(size, size) > config.region_rows
        member = ~small & ~large
        a, b = [node[large], node[member]], [node[first[large]], sig[member].view(np.int64)]
        kind = [np.full(len(a[0]), 2), np.full(len(a[1]), 1)]
        for step in range(1, config.few):
            i = np.flatnonzero(small & (left > step))
            if not len(i):
                break
            a.append(node[i + step])
            b.append(node[i])
            kind.append(np.zeros(len(i), dtype=np.int64))
        a, b, kind = (np.concatenate(x) for x in (a, b, kind))
        order = np.lexsort((kind, b, a))
        a, b, kind = a[order], b[order], kind[order]
        keep = np.ones(len(a), dtype=bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])
        at = np.flatnonzero(keep)
        n = np.diff(np.append(at, len(a)))
        out = pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), *(pa.array(x.astype(np.int32)) for x in (kind[at], n, np.zeros(len(at))))], names=names)
        del sig, node, order, new, a, b, kind, keep, first, left, small, large
        release()
        yield out

    names = ["a", "b", "kind", "n", "m"]
    dealt = docs.select("text").mapInArrow(deal, "bucket int, blob binary")
    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, "a bigint, b bigint, kind int, n int, m int")


def _fits(config: JoinConfig, na, nb):
    return (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * config.percent)


def possible(found: DataFrame, rows: DataFrame, config: JoinConfig) -> DataFrame:
    """Candidate links (a, b) without those that the number of shared signatures, sizes or profiles rule out."""
    facts = found.where("kind >= 16").groupBy("a").agg(F.first("b").alias("n"), F.first(F.col("kind")).alias("c"), F.first("n").alias("own"), F.first("m").alias("next"))
    # Signatures that a node has in larger groups are not counted pair by pair.
    away = found.where("kind IN (1, 2)").groupBy("a").agg(F.sum("n").alias("away"))
    facts = stored(facts.join(away, "a", "left").fillna(0, ["away"]))
    side = lambda k: facts.select(F.col("a").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "c", "own", "next", "away")))
    up = lambda x, y: F.greatest(F.when(F.col(f"c_{y}") == F.col(f"c_{x}") + 1, F.col(f"next_{x}")).otherwise(0), F.col(f"own_{y}"))
    need = F.when(F.col("c_a") == F.col("c_b"), F.greatest("own_a", "own_b")).when(F.col("c_a") < F.col("c_b"), up("a", "b")).otherwise(up("b", "a"))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * config.percent
    seen = rows.where("node is not null").groupBy("node").agg(F.first("profile").alias("profile"), F.first("n_shingles").alias("n"))
    left = seen.select(F.col("node").alias("a"), F.col("profile").alias("pa"), F.col("n").alias("na"))
    right = seen.select(F.col("node").alias("b"), F.col("profile").alias("pb"), F.col("n").alias("nb"))
    close = lambda d, na, nb: d * (100 + config.percent) <= (na + nb) * (100 - config.percent)

    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keep = []
            for x, y, na, nb in zip(*(batch.column(c).to_pylist() for c in ("pa", "pb", "na", "nb"))):
                width = min(len(x), len(y))
                keep.append(close(int(np.abs(folded(x, width) - folded(y, width)).sum()), na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    def pivot(group: pa.Table) -> pa.Table:
        node, n, raw = group.column("a").to_numpy(), group.column("na").to_numpy(), group.column("pa").to_pylist()
        width = min(map(len, raw))
        x = np.stack([folded(r, width) for r in raw])
        label = np.arange(len(node))
        for p in range(len(node)):
            rest = p + 1 + np.flatnonzero(label[p + 1 :] != label[p])
            rest = rest[_fits(config, n[rest], n[p])]
            if len(rest):
                near = rest[close(np.abs(x[rest] - x[p]).sum(axis=1), n[rest], n[p])]
                if len(near):
                    label[np.isin(label, label[near])] = label[p]
        root = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(root, label, node)
        keep = root[label] != node
        return pa.table({"a": node[keep], "b": root[label][keep]})

    def judged(met: DataFrame) -> DataFrame:
        """Pairs of ``met``. Pairs that meet by chance grow with the square of the documents: what one side alone rules out is
        dropped before the pairs are dealt a second time."""
        one = met.select("a", "b", F.col("n").alias("met")).join(side("a"), "a").groupBy("a", "b").agg(F.sum("met").alias("met"), *(F.first(c).alias(c) for c in ("n_a", "c_a", "own_a", "next_a", "away_a")))
        one = one.where(F.col("met") >= F.least("own_a", "next_a") - F.col("away_a"))
        pairs = one.join(side("b"), "b").where(fits & (F.col("met") >= need - F.least("away_a", "away_b"))).select("a", "b")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb", "na", "nb").mapInArrow(judge, "a bigint, b bigint")

    met = found.where("kind = 0")
    rounds = max(1, -(-met.count() // max(config.round_pairs, config.pairs_a_node * facts.count())))
    if rounds == 1:
        pairs = judged(met)
    else:
        for i in range(rounds):
            part = stored(judged(met.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == i)))
            pairs = part if not i else pairs.union(part)
            free_shuffles(found.sparkSession)
    groups = found.where("kind = 1").join(left, "a").select("a", F.col("b").alias("sig"), "pa", "na").groupBy("sig").applyInArrow(pivot, "a bigint, b bigint")
    return pairs.union(groups).union(found.where("kind = 2").select("a", "b"))


def linked(inter: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n + sizes - inter)


def pivot_join(sets: list[np.ndarray], config: JoinConfig, known: np.ndarray | None = None) -> np.ndarray:
    """Components of one region: for each set the index of its component, by pivots and triangle-inequality windows.

    Sets of equal ``known`` are joined already.
    """
    k = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
    flags = np.zeros(len(universe), dtype=bool)
    label = np.arange(k) if known is None else np.unique(known, return_inverse=True)[1]
    away = (100 - config.percent) / 100 + 1e-12
    windows: list[np.ndarray] = []
    open_ = np.ones(k, dtype=bool)
    for x in np.argsort(-sizes, kind="stable"):
        open_[x] = False
        near = open_ & (label != label[x]) & (sizes * 100 >= sizes[x] * config.percent) & (sizes * config.percent <= sizes[x] * 100)
        for d in windows:
            near &= np.abs(d - d[x]) <= away
        own = ids[first[x] : first[x + 1]]
        full = len(windows) < config.pivots and x % max(1, k // (4 * config.pivots)) == 0
        if not (full or near.any()):
            continue
        flags[own] = True
        if full or near.sum() > k // 2:
            inter = np.add.reduceat(flags[ids].astype(np.int32), first[:-1]).astype(np.int64)
            if full:
                windows.append(1 - inter / (sizes + sizes[x] - inter))
            hit = near & linked(inter, len(own), sizes, config.percent)
        else:
            at = np.flatnonzero(near)
            inter = np.array([np.count_nonzero(flags[ids[first[i] : first[i + 1]]]) for i in at])
            hit = np.zeros(k, dtype=bool)
            hit[at] = linked(inter, len(own), sizes[at], config.percent)
        flags[own] = False
        if hit.any():
            joined = np.unique(np.append(label[hit], label[x]))
            label[np.isin(label, joined)] = joined[0]
        if not open_.any():
            break
    return label


def _sets(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=U64) for x in batch.column("items").to_pylist()]


def _join_groups(config: JoinConfig):
    def run(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        _, keep = np.unique(node, return_index=True)
        sets = _sets(group.take(pa.array(keep)))
        node, root = node[keep], group.column("root").to_numpy()[keep]
        label = pivot_join(sets, config, root)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        release()
        return pa.table({"a": pa.array(node), "b": pa.array(least[label])})

    return run


def _distances(config: JoinConfig):
    """One slice of a region against the region's pivots: the distance of every node to every pivot."""

    def run(group: pa.Table, pivots: pa.Table) -> pa.Table:
        node, sets, p_node, p_sets = group.column("node").to_numpy(), _sets(group), pivots.column("node").to_numpy(), _sets(pivots)
        empty = {c: [] for c in ("region", "node", "pivot", "away", "core")}
        if not sets or not p_sets:
            return pa.table(empty, schema=schema)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
        away, core = np.empty((len(p_sets), len(sets))), np.zeros((len(p_sets), len(sets)), dtype=bool)
        for i, p in enumerate(p_sets):
            at = np.searchsorted(universe, p)
            at = at[universe[np.minimum(at, len(universe) - 1)] == p]
            flags = np.zeros(len(universe), dtype=bool)
            flags[at] = True
            inter = np.add.reduceat(flags[ids].astype(np.int32), first).astype(np.int64)
            away[i] = 1 - inter / (sizes + len(p) - inter)
            core[i] = linked(inter, len(p), sizes, config.percent)
        limit = away.min(axis=0) + 2 * (100 - config.percent) / 100 + 1e-9
        i, j = np.nonzero((away <= limit) | core)
        region = group.column("region")[0].as_py()
        del sets, p_sets, ids, universe
        release()
        return pa.table({"region": pa.array(np.full(len(i), region)), "node": pa.array(node[j]), "pivot": pa.array(p_node[i]), "away": pa.array(away[i, j]), "core": pa.array(core[i, j])}, schema=schema)

    schema = pa.schema([("region", pa.int64()), ("node", pa.int64()), ("pivot", pa.int64()), ("away", pa.float64()), ("core", pa.bool_())])
    return run


def _with_roots(keys: DataFrame, links: DataFrame | None) -> DataFrame:
    """``keys`` (region, node) with the root of each node under the links so far."""
    if links is None:
        return keys.withColumn("root", F.col("node"))
    roots = components(links).groupBy("node").agg(F.min("root").alias("root"))
    return keys.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _pivot_level(keys: DataFrame, members: DataFrame, sizes: DataFrame, level: int, config: JoinConfig) -> DataFrame:
    """(region, node, pivot, away, core) of the nodes of large regions, for the pivots in whose windows they are."""
    order = F.xxhash64("node", F.lit(level))
    held = keys.join(sizes, "region")
    chosen = held.where(F.pmod(order, F.col("rows")) < config.pivots).select("region", "node")
    least = held.groupBy("region").agg(F.min_by("node", order).alias("node"))  # where no node is drawn
    pivots = stored(chosen.union(least).distinct().join(members.select("node", "items"), "node"))
    slices = F.ceil(F.greatest(F.col("rows") / F.lit(config.region_rows), F.col("total") / F.lit(config.region_items)) * 4).cast("long")
    dealt = held.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(7)), slices)).join(members.select("node", "items"), "node").select("region", "slice", "node", "items")
    spread = pivots.join(sizes, "region").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).select("region", "slice", "node", "items")
    found = dealt.groupBy("region", "slice").cogroup(spread.groupBy("region", "slice")).applyInArrow(_distances(config), "region bigint, node bigint, pivot bigint, away double, core boolean")
    return stored(found)


def _thinned(level: DataFrame, links: DataFrame, config: JoinConfig) -> DataFrame:
    """The next regions (region, node, root, minor): a pivot's window, without pivots, whose links are all known, and without
    the nodes of the window's largest component that no other node there may be linked to."""
    near = (100 - config.percent) / 100 + 1e-9
    pivots = level.select(F.col("pivot").alias("node")).distinct()
    rest = _with_roots(level.join(pivots, "node", "left_anti").select(F.xxhash64("region", "pivot").alias("region"), "node", "away"), links)
    rest = stored(rest)
    count = rest.groupBy("region", "root").agg(F.count(F.lit(1)).alias("rows"))
    main = count.groupBy("region").agg(F.max_by("root", F.struct("rows", "root")).alias("main"))
    rest = rest.join(main, "region").withColumn("minor", F.col("root") != F.col("main"))
    span = rest.where("minor").groupBy("region").agg(F.min("away").alias("lo"), F.max("away").alias("hi"))
    return rest.join(span, "region").where(F.col("minor") | F.col("away").between(F.col("lo") - near, F.col("hi") + near)).select("region", "node", "root", "minor")


def _blocks(keys: DataFrame, members: DataFrame, config: JoinConfig) -> DataFrame:
    """(region, node, root, items) of pairs of blocks: those outside a region's largest component against all."""
    full = keys.join(members.select("node", "n"), "node")
    size = lambda w: F.greatest(F.sum(F.when(w, 1)) / F.lit(config.region_rows / 2), F.sum(F.when(w, F.col("n"))) / F.lit(config.region_items / 2))
    count = full.groupBy("region").agg(F.ceil(F.coalesce(size(F.col("minor")), F.lit(1))).alias("few"), F.ceil(size(F.lit(True))).alias("many"))
    dealt = full.join(count, "region")
    own = F.xxhash64("node", F.lit(11))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    against = dealt.withColumn("i", F.explode(each("few"))).withColumn("j", F.pmod(own, F.col("many")))
    minor = dealt.where("minor").withColumn("i", F.pmod(own, F.col("few"))).withColumn("j", F.explode(each("many")))
    both = against.select("region", "i", "j", "node", "root").union(minor.select("region", "i", "j", "node", "root")).distinct()
    return both.select(F.xxhash64("region", "i", "j").alias("region"), "node", "root").join(members.select("node", "items"), "node")


def region_links(members: DataFrame, config: JoinConfig) -> tuple[DataFrame, bool]:
    """Links (node a, node b) that join the members (region, node, n, items) of each region; whether they need components."""
    kind = "a bigint, b bigint"
    bound = (F.col("rows") > 2) & ((F.col("rows") > config.region_rows) | (F.col("total") > config.region_items))
    keys, links, level = members.select("region", "node", F.col("node").alias("root"), F.lit(True).alias("minor")), None, 0
    ready, before = [], None
    while True:
        weighed = keys.join(members.select("node", "n"), "node").groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
        large = stored(weighed.where(bound))
        if large.isEmpty():
            ready.append(keys)
            break
        ready.append(keys.join(large, "region", "left_anti"))
        big = stored(keys.join(large.select("region"), "region", "left_semi"))
        total = large.agg(F.sum("total")).first()[0]
        if level == config.levels or (before is not None and total > 0.7 * before):
            ready.append(_blocks(big, members, config))  # pivots no longer thin these regions out
            break
        before, level = total, level + 1
        found = _pivot_level(big, members, large, level, config)
        direct = found.where("core").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        links = stored(direct if links is None else links.union(direct))
        keys = stored(_thinned(found, links, config))
    whole = [k if "items" in k.columns else k.join(members.select("node", "items"), "node") for k in ready]
    met = whole[0].select("region", "node", "root", "items")
    for w in whole[1:]:
        met = met.union(w.select("region", "node", "root", "items"))
    met = met.groupBy("region").applyInArrow(_join_groups(config), kind)
    return (met if links is None else met.union(links)), len(ready) > 1


def joined(docs: DataFrame, config: JoinConfig, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry``, n_shingles, component_id, node and root (one a component, null for an empty set) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(nodes(docs, config, carry))
    near = stored(candidates(docs, config))
    free_shuffles(docs.sparkSession)
    maybe = stored(possible(near, rows, config))
    discard(near)
    coarse = components(maybe)
    discard(maybe)
    heads = rows.where("node is not null").join(coarse, "node").groupBy("node", "root").agg(F.min("doc_id").alias("head"), F.max("n_shingles").alias("n"))

    def fetch(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source, "text"):
            sets = shingle_sets(texts, config.k)
            node = batch.column("node").to_pylist()
            keep = [i for i, s in enumerate(sets) if len(s) and digest(s) == node[i]]
            yield pa.RecordBatch.from_arrays([batch.column("root").take(pa.array(keep, pa.int64())), pa.array([node[i] for i in keep], pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["region", "node", "n", "items"])

    wanted = docs.select(F.col("doc_id").alias("head"), "text").join(heads.withColumnRenamed("head", "wanted"), F.col("head").eqNullSafe(F.col("wanted")))
    members = stored(wanted.select("root", "node", "text").mapInArrow(fetch, "region bigint, node bigint, n bigint, items binary"))
    free_shuffles(docs.sparkSession)
    links, split = region_links(members, config)
    final = components(links) if split else stored(links.select(F.col("a").alias("node"), F.col("b").alias("root")))
    own = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = own.join(final.groupBy("node").agg(F.min("root").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = named.join(ids, "root").select("node", "component_id", "root")
    out = rows.drop("profile").join(by_node, "node", "left")
    return out.select("doc_id", *carry, "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).cast(kind).alias("component_id"), "node", "root")


def ngram_join(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and node of every document."""
    return joined(docs, config).drop("root")


def row_mark(docs: DataFrame) -> F.Column:
    """A 64-bit digest of a whole row; columns that hold maps, which have no order, are left out."""
    held = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*(x for c in held for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))


def near_duplicates_removed(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """``docs`` with one row of each group of links: that of least doc_id (null last), and of those the one of least digest.

    It is rows that are judged, not ids: rows of a null or shared doc_id that no links join all stay, as do rows of empty
    sets. A row that is repeated in all its columns stays once.
    """
    mark = f"row_mark_{uuid.uuid4().hex}"
    rows = joined(docs.select("doc_id", "text", row_mark(docs).alias(mark)), config, (mark,))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(mark).alias("mark")))
    kept = rows.groupBy("root", F.when(F.col("root").isNull(), F.col(mark)).alias("alone")).agg(first.alias("kept")).select(F.col("kept.mark").alias(mark))
    return docs.withColumn(mark, row_mark(docs)).join(kept, mark).dropDuplicates([mark]).drop(mark)


def join_sql(percent: int = 90) -> str:
    """The links of three-word shingles by all pairs that share one, and their components, for DuckDB."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n i ON x = i.doc_id JOIN n j ON y = j.doc_id WHERE 100 * c >= {percent} * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x AND r.root < e.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.component_id FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) d LEFT JOIN n ON d.doc_id = n.doc_id"""
