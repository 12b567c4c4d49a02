"""Corpus operators: which excerpts occur in which documents, and where.

Search is one pass over the documents per block of excerpts: an automaton of all needles, of bounded size, is broadcast,
and every document is read once whatever the number of excerpts. Documents are not shuffled. A nested-loop join with
``contains`` is the other physical form, for a handful of excerpts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.approx import GramFilter
from ..functions.markdown import FLATTENERS, flatten, joined
from ..functions.rules import rules, to_column
from ..functions.scalars import line_of, occurrences, utf16_offset
from ..options import NO_MATCH, MatchOptions, with_preset
from .pairs import CAP, Matcher, _utf16, chain, implicit_anchors, marked_anchors, normalize, visible_text

try:
    import ahocorasick
except ImportError:  # the nested-loop form needs no automaton
    ahocorasick = None

#: Characters of needles that are broadcast at once.
BLOCK_CHARS = 8_000_000
RESULT = "found boolean, index int, length int, cp_index int, cp_length int, kind string, score double, occurrences int, punct_folded boolean, crosses_blocks boolean, via string, source string, text string, line int"


def parallel(docs: DataFrame) -> DataFrame:
    """``docs`` in a task for every core: a file of one row group is one task otherwise. Inputs of as many splits as cores, and so
    all large ones, stay as they are and are not shuffled."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if docs.rdd.getNumPartitions() < cores else docs


def blocks(excerpts: DataFrame, columns: list[str], limit: int = BLOCK_CHARS) -> Iterator[list]:
    """Rows of excerpts, a bounded block at a time."""
    held, size = [], 0
    for row in excerpts.select(*columns).toLocalIterator():
        held.append(tuple(row))
        size += sum(len(x) for x in row if isinstance(x, str))
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _automaton(words: dict[str, list]):
    a = ahocorasick.Automaton()
    for w, ids in words.items():
        a.add_word(w, (len(w), ids))
    a.make_automaton()
    return a


def exact_pairs(docs: DataFrame, excerpts: DataFrame, doc_id: str = "doc_id", excerpt_id: str = "item_id", text: str = "text", needle: str = "text", coordinates: bool = False) -> DataFrame:
    """doc id, excerpt id, cp_index (first place), occurrences (overlapping, at most 50) of verbatim containment; with
    ``coordinates`` also index and length in UTF-16 units, cp_length and line.

    Null and empty needles or texts match nothing. Rows are judged one by one, so null and repeated ids are kept apart.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), excerpts.schema[excerpt_id].dataType.simpleString()
    more = ["index", "length", "cp_length", "line"] if coordinates else []
    schema = ", ".join([f"{doc_id} {kinds[0]}, {excerpt_id} {kinds[1]}, cp_index int, occurrences int", *(f"{c} int" for c in more)])
    out = None
    kind = excerpts.select(excerpt_id).schema
    for rows in blocks(excerpts, [excerpt_id, needle]):
        words: dict[str, list] = {}
        for i, w in rows:
            if w:
                words.setdefault(w, []).append(i)
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            machine = _automaton(shared.value)
            id_type = to_arrow_type(kind[0].dataType)
            for b in source:
                at, ids, found = [], [], []
                for row, t in enumerate(b.column(text).to_pylist()):
                    seen: dict[tuple, list] = {}
                    if t and len(machine):
                        for end, (n, owners) in machine.iter(t):
                            hit = seen.setdefault((n, id(owners)), [end - n + 1, 0, owners])
                            hit[1] += 1
                    for (size, _), (place, n, owners) in seen.items():
                        own = [place, min(n, CAP)]
                        if coordinates:
                            own += [*_utf16(t, place, place + size), size, 1 + t.count("\n", 0, place)]
                        at += [row] * len(owners)
                        ids += owners
                        found += [own] * len(owners)
                columns = list(zip(*found)) or [()] * (2 + len(more))
                yield pa.RecordBatch.from_arrays([b.column(doc_id).take(pa.array(at, pa.int64())), pa.array(ids, id_type), *(pa.array(c, pa.int32()) for c in columns)], names=[doc_id, excerpt_id, "cp_index", "occurrences", *more])

        part = docs.select(doc_id, text).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def exact_pairs_native(docs: DataFrame, excerpts: DataFrame, doc_id: str = "doc_id", excerpt_id: str = "item_id") -> DataFrame:
    """The same as a broadcast nested loop over native expressions; right for a handful of excerpts."""
    few = excerpts.select(F.col(excerpt_id), F.col("text").alias("needle")).where("needle <> ''")
    hits = docs.select(doc_id, "text").join(F.broadcast(few), F.contains("text", "needle"))
    return hits.select(doc_id, excerpt_id, (F.expr("locate(needle, text)") - 1).alias("cp_index"), occurrences(F.col("text"), F.col("needle")).alias("occurrences"))


def exact_matches(docs: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Verbatim hits with coordinates in UTF-16 and code points, and line numbers, in the one pass that finds them."""
    hits = exact_pairs(docs, excerpts, coordinates=True)
    return hits.select("doc_id", "item_id", F.lit("exact").alias("kind"), "index", "length", "cp_index", "cp_length", "occurrences", F.col("line").cast("long").alias("line"))


def normalized_column(column: str, o: MatchOptions) -> F.Column:
    return to_column(F.col(column), rules(o))


def normalized_pairs(docs: DataFrame, excerpts: DataFrame, o: MatchOptions | None = None) -> DataFrame:
    """Containment of the normalised excerpt in the normalised document; both sides are normalised natively."""
    o = o or with_preset()
    hay = docs.select("doc_id", normalized_column("text", o).alias("text"))
    return exact_pairs(hay, excerpts.select("item_id", normalized_column("text", o).alias("text")))


class Wanted:
    """A block of excerpts made ready to be sought in every document.

    A document's view is looked at for an excerpt if it holds the excerpt or its normalised form, all of its anchors in order
    within the gap, or, where there are fallbacks, enough of its pieces.
    """

    def __init__(self, texts: list[str | None], o: MatchOptions):
        plain = replace(o, markdown=None)
        self.chains: list[list[tuple[list[str], float]]] = []
        self.whole: list[set[str]] = []
        self.words: dict[str, list[int]] = {}
        needles = []
        for i, text in enumerate(texts):
            shown = (flatten(text).text.rstrip("\n") if o.excerpt_is_markdown and o.markdown else text) if text else ""
            n = normalize(shown, plain).text if shown else ""
            anchors = [(marked_anchors(n, plain), plain.max_gap)] if n else []
            if n and plain.implicit_gap is not None:
                anchors.append((implicit_anchors(shown, plain), plain.implicit_gap))
            self.chains.append([(a, gap) for a, gap in anchors if a])
            self.whole.append({x for x in (n, "" if o.excerpt_is_markdown else text) if x})
            for key in {a[0] for a, _ in self.chains[i]} | self.whole[i]:
                self.words.setdefault(key, []).append(i)
            needles.append(n)
        self.machine = _automaton(self.words)
        self.grams = GramFilter(needles, o.min_fallback_score) if o.fallbacks else None

    def near(self, text: str, norm: str) -> set[int]:
        """The excerpts that a view of a document, as it is and normalised, is to be matched with."""
        out: set[int] = set(self.grams.near(norm)) if self.grams else set()
        if len(self.machine):
            met = {i for part in {text, norm} for _, (_, owners) in self.machine.iter(part) for i in owners} - out
            out |= {i for i in met if any(w in text or w in norm for w in self.whole[i]) or any(chain(norm, a, gap) for a, gap in self.chains[i])}
        return out


def _row(m: dict, text: str, o: MatchOptions, least: float) -> dict:
    found = m["kind"] != "none" and m["score"] >= least
    if not found and m["kind"] != "none":
        m = {**m, **NO_MATCH, "cp_index": -1, "cp_length": 0, "punct_folded": None, "crosses_blocks": None, "via": None}
    source = text[m["cp_index"] : m["cp_index"] + m["cp_length"]] if found else ""
    return {**m, "found": found, "source": source, "text": visible_text(source, o), "line": 1 + text.count("\n", 0, m["cp_index"]) if found else -1}


def match_pairs(pairs: DataFrame, o: MatchOptions | None = None, keys: list[str] | None = None, document: str = "document", excerpt: str = "excerpt", min_score: float = 0.0) -> DataFrame:
    """The ladder for given pairs: one result row for every row, misses included.

    Pairs of one document should be neighbours: a worker keeps its last documents prepared.
    """
    return _matched(pairs, [(None, o or with_preset())], None, keys, document, excerpt, min_score)


def match_pairs_by(pairs: DataFrame, options: dict[str, MatchOptions], name: str, keys: list[str] | None = None, document: str = "document", excerpt: str = "excerpt", min_score: float = 0.0) -> DataFrame:
    """``match_pairs`` under several sets of options in one pass: a result row for every row and set, whose name is in the
    column ``name``. Documents are prepared once for all sets that differ in what is done afterwards only."""
    return _matched(pairs, list(options.items()), name, keys, document, excerpt, min_score)


def _matched(pairs: DataFrame, options: list[tuple[str | None, MatchOptions]], name: str | None, keys: list[str] | None, document: str, excerpt: str, min_score: float) -> DataFrame:
    keys = keys if keys is not None else [c for c in pairs.columns if c not in (document, excerpt)]
    types = [*(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys), *([f"`{name}` string"] if name else []), RESULT]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [(Matcher(o), o) for _, o in options]
        for b in source:
            texts, parts = b.column(document).to_pylist(), b.column(excerpt).to_pylist()
            rows = [_row(m.match(e, t), t or "", o, min_score) for e, t in zip(parts, texts) for m, o in matchers]
            at = pa.array([k for k in range(len(texts)) for _ in options], pa.int64())
            names = [pa.array([n for n, _ in options] * len(texts), pa.string())] if name else []
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), *names, *_arrays(rows)], names=[*keys, *([name] if name else []), *(n for n, _ in _fields())])

    return pairs.select(*keys, document, excerpt).mapInArrow(run, ", ".join(types))


def _fields() -> list[tuple[str, pa.DataType]]:
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    return [(n, kinds[t]) for n, t in (f.split() for f in RESULT.split(", "))]


def _arrays(rows: list[dict]) -> list[pa.Array]:
    return [pa.array([r[n] for r in rows], t) for n, t in _fields()]


def locate(docs: DataFrame, excerpts: DataFrame, o: MatchOptions | None = None, min_score: float = 0.0, exhaustive: bool = False) -> DataFrame:
    """All hits of a table of excerpts in a corpus: doc_id, item_id and the result columns; misses are left out.

    A document is matched with the excerpts that ``Wanted.near`` names. For all tiers but the fuzzy one that leaves nothing
    out. Fuzzy hits are found for certain up to (1 - min_fallback_score) * 2 / 3 edits a character of the excerpt, one in six at
    0.75; ``exhaustive`` matches every document with every excerpt, for scores reached with more edits than that.
    """
    o = o or with_preset()
    kinds = docs.schema["doc_id"].dataType.simpleString(), excerpts.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, {RESULT}"
    out = None
    plain = replace(o, markdown=None)
    native = not (o.markdown or o.cjk_numerals or o.ignore_particles)
    hay = normalized_column("text", plain) if native else F.lit(None).cast("string")
    for rows in blocks(excerpts, ["item_id", "text"]):
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        id_field = excerpts.select("item_id").schema[0]

        def run(source: Iterator[pa.RecordBatch], shared=shared, id_field=id_field) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            rows, matcher = shared.value, Matcher(o)
            wanted = Wanted([t for _, t in rows], o)
            for b in source:
                at, ids, found = [], [], []
                for row, (t, norm) in enumerate(zip(b.column("text").to_pylist(), b.column("norm").to_pylist())):
                    if not t:
                        continue
                    if exhaustive:
                        near = set(range(len(rows)))
                    else:
                        near = set().union(*(wanted.near(x, norm if native else normalize(x, plain).text) for x in searched_texts(t, o)))
                    for i in sorted(near):
                        r = _row(matcher.match(rows[i][1], t), t, o, min_score)
                        if r["found"]:
                            at.append(row)
                            ids.append(rows[i][0])
                            found.append(r)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(ids, to_arrow_type(id_field.dataType)), *_arrays(found)], names=["doc_id", "item_id", *(n for n, _ in _fields())])

        part = docs.select("doc_id", "text", hay.alias("norm")).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def searched_texts(text: str, o: MatchOptions) -> list[str]:
    """The texts that are searched: the document, or what its markup shows, with and without block separators."""
    if not o.markdown:
        return [text]
    flat = FLATTENERS[o.markdown](text)
    return [flat.text, *(j.text for j in [joined(flat)] if j)]


def with_misses(pairs: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs, those without a hit as the constant miss row."""
    joined_rows = pairs.select(*keys).join(hits, keys, "left")
    fill = {"found": F.lit(False), "index": F.lit(-1), "length": F.lit(0), "cp_index": F.lit(-1), "cp_length": F.lit(0), "kind": F.lit("none"), "score": F.lit(0.0), "occurrences": F.lit(0), "line": F.lit(-1), "source": F.lit(""), "text": F.lit("")}
    return joined_rows.withColumns({c: F.coalesce(c, v) for c, v in fill.items() if c in hits.columns})


def check_invariants(results: DataFrame, length: str = "n_units") -> DataFrame:
    """Result rows that break the contract: spans in bounds, scores in [0, 1], misses constant."""
    hit = (F.col("kind") != "none") & ~((F.col("index") >= 0) & (F.col("length") > 0) & (F.col("index") + F.col("length") <= F.col(length)) & (F.col("occurrences") >= 1) & F.col("score").between(0, 1))
    missed = (F.col("kind") == "none") & ~((F.col("index") == -1) & (F.col("length") == 0) & (F.col("score") == 0) & (F.col("occurrences") == 0))
    return results.where(hit | missed)
