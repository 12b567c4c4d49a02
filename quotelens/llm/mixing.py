"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network carries word
capacity from patterns to source quotas: the first copy of a pattern's words costs nothing and each further copy costs
more (convex repetition costs), so repetition is used only where quotas cannot be met otherwise. The network has one
node per pattern and source, never per document. Documents are then selected in a seeded order: running sums come from
a (pattern, slice of the order) table, so that no window holds more than 1/4096 of a pattern.

Defined cases: null text counts as size 0 and takes nothing; a null source is a source of its own, ordered last;
repeated rows each count; ties of the seeded order fall to doc_id and size; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textcore import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = WEIGHTS  #: given to sources in order, repeating
    share: float = 1.5  #: words of the mix as a multiple of all words
    repeats: int = 2  #: most copies of a document
    seed: int = 42
    max_patterns: int = 200_000  #: the network is solved on the driver; more patterns raise an error


def fill_targets(sizes: list[int], weights: list[int], total: float, repeats: int) -> list[float]:
    """Targets proportional to weight, none above ``repeats`` x its size; what is cut off is shared anew by weight."""
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    rest, mass = float(total), float(sum(weights))
    for at, i in enumerate(order):
        if rest * weights[i] / mass > repeats * sizes[i]:
            out[i] = float(repeats * sizes[i])
            rest -= repeats * sizes[i]
            mass -= weights[i]
        else:
            for j in order[at:]:
                out[j] = rest * weights[j] / mass
            break
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int) -> list[dict[int, int]]:
    """Min-cost max-flow by successive cheapest paths: words that each pattern sends to each of its sources."""
    n_p, n_s = len(patterns), len(quotas)
    source, sink = n_p + n_s, n_p + n_s + 1
    to, cap, cost = [], [], []
    out: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)

    for p, (members, size) in enumerate(patterns):
        for copy in range(repeats):
            arc(source, p, size, copy)
        for s in members:
            arc(p, n_p + s, repeats * size, 0)
    for s, q in enumerate(quotas):
        arc(n_p + s, sink, q, 0)
    while True:
        far = [float("inf")] * len(out)
        back = [-1] * len(out)
        queued = [False] * len(out)
        far[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            queued[a] = False
            for e in out[a]:
                if cap[e] and far[a] + cost[e] < far[to[e]]:
                    far[to[e]], back[to[e]] = far[a] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if back[sink] < 0:
            break
        path, at = [], sink
        while at != source:
            path.append(back[at])
            at = to[back[at] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    flows: list[dict[int, int]] = [{} for _ in patterns]
    for p in range(n_p):
        for e in out[p]:
            if n_p <= to[e] < n_p + n_s and e % 2 == 0 and cap[e ^ 1]:
                flows[p][to[e] - n_p] = cap[e ^ 1]
    return flows


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size and the singleton membership of the documents table."""
    size = F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')").cast("long"), F.lit(0).cast("long"))
    return docs.select("doc_id", size.alias("size"), F.array("source").alias("sources"))


def mix(rows: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """``rows`` (doc_id, size, sources) with source_size and target of the first source, and the words taken.

    ``taken`` counts repeats; ``allotted`` says how many of them each source pays for.
    """
    spark = rows.sparkSession
    key = F.md5(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = stored(rows.select("doc_id", "size", F.array_sort(F.array_distinct("sources")).alias("sources"), key.alias("key")).withColumn("slot", F.substring("key", 1, 3)))
    slots = rows.groupBy("sources", "slot").agg(F.sum("size").alias("slot_size"))
    patterns = slots.groupBy("sources").agg(F.sum("slot_size").alias("size")).limit(config.max_patterns + 1).collect()
    if len(patterns) > config.max_patterns:
        raise ValueError(f"more than {config.max_patterns} membership patterns")
    names = sorted({s for r in patterns for s in r["sources"]}, key=lambda s: (s is None, s))
    index = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in patterns:
        for s in r["sources"]:
            sizes[index[s]] += r["size"]
    weights = [config.weights[i % len(config.weights)] for i in range(len(names))]
    targets = fill_targets(sizes, weights, config.share * sum(r["size"] for r in patterns), config.repeats)
    quotas = [int(t + 0.5) for t in targets]
    flows = route([(tuple(index[s] for s in r["sources"]), r["size"]) for r in patterns], quotas, config.repeats)
    plan = []
    for i, (r, flow) in enumerate(zip(patterns, flows)):
        ends, at = [], 0
        for s, words in sorted(flow.items()):
            ends.append((names[s], at, at + words))
            at += words
        first = index[r["sources"][0]] if r["sources"] else None
        plan.append((i, r["sources"], r["size"], at, ends, sizes[first] if r["sources"] else 0, targets[first] if r["sources"] else 0.0))
    schema = "pattern int, p_sources array<string>, p_size long, flow long, spans array<struct<source:string,lo:long,hi:long>>, source_size long, target double"
    plan = F.broadcast(spark.createDataFrame(plan, schema))
    before = Window.partitionBy("pattern").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("pattern", "slot").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("sources").eqNullSafe(F.col("p_sources"))
    offsets = slots.join(plan.select("pattern", "p_sources"), match).withColumn("offset", F.coalesce(F.sum("slot_size").over(before), F.lit(0))).select("pattern", "slot", "offset")
    placed = rows.join(plan, match).withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, ["pattern", "slot"]).withColumn("start", F.col("start") + F.col("offset"))
    copies = F.sequence(F.lit(0), F.lit(config.repeats - 1))
    part = lambda lo, hi: F.greatest(F.lit(0).cast("long"), F.least(F.col("start") + F.col("size") + lo, hi) - F.greatest(F.col("start") + lo, F.lit(0)))
    taken = F.aggregate(copies, F.lit(0).cast("long"), lambda acc, c: acc + part(c * F.col("p_size"), F.col("flow")))
    overlap = lambda c, span: F.greatest(F.lit(0).cast("long"), F.least(F.col("start") + F.col("size") + c * F.col("p_size"), span["hi"]) - F.greatest(F.col("start") + c * F.col("p_size"), span["lo"]))
    allotted = F.transform("spans", lambda span: F.struct(span["source"].alias("source"), F.aggregate(copies, F.lit(0).cast("long"), lambda acc, c: acc + overlap(c, span)).alias("words")))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), allotted.alias("allotted"))


def mix_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The documents table mixed by its source column."""
    return mix(measured(docs), config)


def mixing_sql(table: str = "documents") -> str:
    """The mix of ``table`` (doc_id, text, source) with the default parameters, for DuckDB."""
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
                  md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM {table}),
s AS (SELECT source, sum(size) AS s_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 1.5 * sum(s_size) OVER () AS total FROM s),
o AS (SELECT *, total - coalesce(sum(2 * s_size) OVER q, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS mass FROM w
      WINDOW q AS (ORDER BY 2.0 * s_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(rest AS DOUBLE) * weight / mass > 2 * s_size AS above FROM o),
l AS (SELECT *, (SELECT arg_min(struct_pack(rest := f2.rest, mass := f2.mass), struct_pack(a := 2.0 * f2.s_size / f2.weight, b := f2.k)) FROM f f2 WHERE NOT f2.above) AS lam FROM f),
t AS (SELECT source, CAST(s_size AS BIGINT) AS source_size, CASE WHEN above THEN CAST(2 * s_size AS DOUBLE) ELSE CAST(lam.rest AS DOUBLE) * weight / lam.mass END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS flow,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(start + size, flow) - start) + greatest(0, least(start + size + source_size, flow) - (start + source_size)) AS BIGINT) AS taken FROM p"""
