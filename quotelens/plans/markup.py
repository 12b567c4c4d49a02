"""Queries of markdown: what is passed over, the view without separators, marker spans and block limits, over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.markdown import flatten, joined
from ..operators.locate import match_pairs_by
from ..options import with_preset
from .queries import _LINES_SQL, _digest, _docs, _markup

_BOLD = lambda s: F.concat(F.lit("**"), F.regexp_extract(s, r"^\S+", 0), F.lit("**"), F.regexp_replace(s, r"^\S+", ""))


def _lines():
    lines = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N} .,\n]", ""), "\n"), lambda s: F.trim(s) != "")
    return F.transform(lines, lambda s: F.trim(s))


def _rows(frame, column: str, make, schema: str):
    """doc_id and what ``make`` says of each text."""
    import pyarrow as pa
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = StructType.fromDDL(schema).fields

    def run(source):
        for b in source:
            rows = [make(t) for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(fields))], names=["doc_id", *(f.name for f in fields)])

    return frame.select("doc_id", column).mapInArrow(run, f"doc_id bigint, {schema}")


def md_policy(spark, sf_dir):
    """Text amid front matter, fences, images, raw markup, rules, definitions, entities, escapes and list items: the text alone is left."""
    first = lambda s: F.concat(F.lit("- ~~"), F.regexp_extract(s, r"^\S+", 0), F.lit("~~"), F.regexp_replace(s, r"^\S+", ""))
    ways = [
        lambda s: F.concat(F.lit("```text\n"), s, F.lit("\n```")),
        lambda s: F.concat(F.lit("![a view](http://a.b/c.png)\n\n"), _BOLD(s)),
        lambda s: F.concat(F.lit("<div>\n</div>\n\n"), _BOLD(s)),
        lambda s: F.concat(F.lit("* * *\n\n"), _BOLD(s)),
        lambda s: F.concat(F.lit("[ref]: http://a.b/c\n\n"), _BOLD(s)),
        lambda s: F.replace(F.replace(_BOLD(s), F.lit("."), F.lit("&#46;")), F.lit(","), F.lit("&#x2c;")),
        lambda s: F.replace(_BOLD(s), F.lit("."), F.lit("\\.")),
        first,
    ]
    dress = lambda s, k: F.element_at(F.array(*[w(s) for w in ways]), (k % len(ways) + 1).cast("int"))
    md = _docs(spark, sf_dir).where(F.size(_lines()) > 0).select("doc_id", F.concat(F.lit("---\ntitle: none\n---\n"), F.array_join(F.transform(_lines(), dress), "\n\n")).alias("md"))

    def make(source: str) -> tuple[str, int]:
        flat = flatten(source)
        return flat.text.rstrip("\n"), len(flat.blocks)

    return _rows(md, "md", make, "text string, n_blocks bigint").select("doc_id", "n_blocks", _digest("text_md5", F.col("text")))


def md_joined(spark, sf_dir):
    """The view of a document without the separators between its blocks, and where its last block ends there."""

    def make(source: str) -> tuple[str, int]:
        view = joined(flatten(source))
        return view.text, view.blocks[-1][1]

    return _rows(_markup(spark, sf_dir), "md", make, "text string, end bigint").select("doc_id", F.col("end").alias("last_end"), _digest("text_md5", F.col("text")))


def marker_spans(spark, sf_dir):
    """The bold first word of every document: its span with its signs, without them, and with signs at the edges trimmed."""
    pairs = _markup(spark, sf_dir).select("doc_id", F.col("md").alias("document"), F.regexp_extract("plain", r"^\S+", 0).alias("excerpt"))
    modes = {"expand": {}, "plain": {"expand_markers": False}, "trim": {"trim_markdown_edges": True}}
    found = match_pairs_by(pairs, {k: with_preset(markdown="commonmark", **v) for k, v in modes.items()}, "mode", keys=["doc_id"])
    return found.select("doc_id", "mode", "kind", "cp_index", "cp_length", F.md5("source").alias("source_md5"), F.md5("text").alias("text_md5"))


def block_limits(spark, sf_dir):
    """The first two blocks of every document as one excerpt: a hit across blocks, unless one block is the limit."""
    md = _markup(spark, sf_dir).where("n_lines >= 2")
    two = F.slice(F.split("plain", "\n"), 1, 2)
    pairs = md.select("doc_id", F.col("md").alias("document"), F.array_join(two, " ").alias("excerpt"))
    limits = {"any": float("inf"), "two": 2, "one": 1}
    found = match_pairs_by(pairs, {k: with_preset(markdown="commonmark", max_cross_blocks=v) for k, v in limits.items()}, "limit", keys=["doc_id"])
    return found.select("doc_id", "limit", "kind", F.coalesce("crosses_blocks", F.lit(False)).alias("crosses_blocks"))


QUERIES = {f.__name__: f for f in (md_policy, md_joined, marker_spans, block_limits)}

_L = f"WITH l AS (SELECT doc_id, {_LINES_SQL} AS l FROM documents), "
_FIRST = _L + "w AS (SELECT doc_id, regexp_extract(l[1], '^\\S+') AS w FROM l WHERE len(l) > 0) "

ORACLES = {
    "md_policy": _L + "x AS (SELECT * FROM l WHERE len(l) > 0) SELECT doc_id, len(l) AS n_blocks, md5(array_to_string(l, chr(10))) AS text_md5 FROM x",
    "md_joined": _L + "x AS (SELECT doc_id, array_to_string(l, '') AS t FROM l WHERE len(l) > 0) SELECT doc_id, length(t) AS last_end, md5(t) AS text_md5 FROM x",
    "marker_spans": _FIRST + "SELECT doc_id, mode, 'exact' AS kind, CASE mode WHEN 'expand' THEN 2 ELSE 4 END AS cp_index, length(w) + CASE mode WHEN 'expand' THEN 4 ELSE 0 END AS cp_length, "
    "md5(CASE mode WHEN 'expand' THEN '**' || w || '**' ELSE w END) AS source_md5, md5(w) AS text_md5 FROM w, (VALUES ('expand'), ('plain'), ('trim')) AS m(mode)",
    "block_limits": _L + "x AS (SELECT doc_id FROM l WHERE len(l) >= 2) SELECT doc_id, m.name AS \"limit\", CASE m.name WHEN 'one' THEN 'none' ELSE 'normalized' END AS kind, m.name <> 'one' AS crosses_blocks "
    "FROM x, (VALUES ('any'), ('two'), ('one')) AS m(name)",
}
