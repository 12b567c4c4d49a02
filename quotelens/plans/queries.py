"""One query per operator over the driver's tables; texts of other scripts come as inline rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import negation, scalars
from ..functions.rules import HOLD, SPACE, ZERO_WIDTH, Lower, Sub, Table, camel_rule, punctuation_table, rules, separators_rule, to_column, width_table
from ..operators import locate, semantic
from ..options import with_preset

SIGNS = "，、﹐。．｡；：？﹖！﹗（﹙）﹚【〔［】〕］“”「」『』＂‘’＇´—–−﹣－⋯《〈》〉"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Inline texts: id, text.
ROWS = [
    (1, "列车没在站台停留"), (2, "列车在站台停留"), (3, "我们不得不等"), (4, "非常高兴"), (5, "他未来会来"), (6, "别人没有说不是"), (7, "无限量的纸张"), (8, "I don't know"),
    (9, "宽广的大地"), (10, "慢慢地走"), (11, "跑得快，值得"), (12, "目的地的土地"), (13, "한국어 문장 입니다"), (14, "ภาษาไทย ทดสอบ"), (15, "日本語のテキスト です"), (16, "中文 AI 中 文"),
    (17, "a😀b 👍🏽 c"), (18, "👨‍👩‍👧 family"), (19, "é é x"), (20, ""),
]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, in a task for every core at least."""
    return locate.parallel(_t(spark, sf_dir, "documents").select("doc_id", "text"))


def _inline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, "id int, text string")


def _values() -> str:
    return "(VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in ROWS) + ") AS v(id, text)"


def _digest(name: str, column: Column) -> Column:
    return F.md5(column).alias(name)


def _mapped(steps: list, name: str = "norm_md5") -> Callable[[SparkSession, str], DataFrame]:
    """doc_id and the digest of the whole text under some rules."""
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", _digest(name, to_column(F.col("text"), steps)))


_SPACE_SQL = "[" + "".join(f"\\x{{{ord(c):x}}}" if c != "-" else c for c in SPACE) + "]"
_ZERO_SQL = "[" + "".join(f"\\x{{{ord(c):x}}}" if c != "-" else c for c in ZERO_WIDTH) + "]"
_TO = "".join(dict(punctuation_table().entries)[c] for c in SIGNS)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _glyphs(x: str) -> str:
    return f"translate({x}, {_q(SIGNS)}, {_q(_TO)})"


def _held(x: str) -> str:
    return f"regexp_replace({x}, '{_SPACE_SQL}+', chr(1), 'g')"


def _dropped(x: str) -> str:
    """Placeholder rules for texts of Latin letters and digits."""
    latin = "A-Za-z\\x{c0}-\\x{24f}"
    x = f"regexp_replace({x}, '^\\x01+|\\x01+$', '', 'g')"
    for _ in range(2):
        for a, b in ((latin, "0-9"), ("0-9", latin)):
            x = f"regexp_replace({x}, '([{a}])\\x01+([{b}])', '\\1\\2', 'g')"
    return x


def _norm(x: str) -> str:
    return _dropped(_held(_glyphs(f"lower({x})")))


_TOKEN_SQL = "[\\p{L}\\p{N}\\p{M}_]+(?:[''\\x{2019}.][\\p{L}\\p{N}\\p{M}_]+)*"
_ENGLISH_SQL = "(" + ", ".join(_q(w) for w in sorted(negation.ENGLISH_NEGATION_WORDS)) + ")"


def _negations_sql(x: str) -> str:
    return f"len(list_filter(regexp_extract_all({x}, '{_TOKEN_SQL}'), lambda w: regexp_matches(w, '^[A-Za-z]') AND (lower(w) IN {_ENGLISH_SQL} OR suffix(lower(w), 'n''t'))))"


_HITS_SQL = "SELECT d.doc_id, b.item_id, strpos(d.text, b.text) - 1 AS cp_index, d.text AS doc, b.text AS needle FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> ''"
_WIDE_SQL = "len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10ffff}}]'))"
_COUNT_SQL = "least(50, len(list_filter(range(1, length(doc) + 1), lambda i: substring(doc, i, length(needle)) = needle)))"


_UPPER_SQL = f"translate(replace(text, ' ', '  '), '{LOWER}', '{LOWER.upper()}')"


def t0_exact_locate(spark, sf_dir):
    return locate.exact_matches(_docs(spark, sf_dir), _t(spark, sf_dir, "benchmark"))


def t0_occurrences(spark, sf_dir):
    return locate.exact_pairs(_docs(spark, sf_dir), _t(spark, sf_dir, "benchmark"))


def t0_native_join(spark, sf_dir):
    return locate.exact_pairs_native(_docs(spark, sf_dir), _t(spark, sf_dir, "benchmark"))


def t0_earliest(spark, sf_dir):
    """Of all documents of an excerpt, the one it occurs in first."""
    hits = locate.exact_pairs(_docs(spark, sf_dir), _t(spark, sf_dir, "benchmark"))
    return hits.groupBy("item_id").agg(F.min(F.struct("cp_index", "doc_id")).alias("first"), F.count(F.lit(1)).alias("n_docs")).select("item_id", "first.cp_index", "first.doc_id", "n_docs")


def _variant(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.translate(F.regexp_replace("text", " ", "  "), LOWER, LOWER.upper()).alias("text"))


def t1_normalized_locate(spark, sf_dir):
    return locate.normalized_pairs(_docs(spark, sf_dir), _variant(_t(spark, sf_dir, "benchmark")))


def _cut(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.length("text") >= 130).select("item_id", F.concat(F.substring("text", 1, 60), F.lit("〔略〕"), F.substring(F.col("text"), F.length("text") - 59, F.lit(60))).alias("text"))


def t2_segmented(spark, sf_dir):
    return locate.locate(_docs(spark, sf_dir), _cut(_t(spark, sf_dir, "benchmark"))).select("doc_id", "item_id", "kind", "occurrences", "score")


def t2_gap_guard(spark, sf_dir):
    return locate.locate(_docs(spark, sf_dir), _cut(_t(spark, sf_dir, "benchmark")), with_preset(max_gap=60)).select("doc_id", "item_id", "kind")


def _cut_sql(gap: str, columns: str) -> str:
    return f"""WITH b AS (SELECT item_id, {_norm('substring(text, 1, 60)')} AS a, {_norm('substring(text, length(text) - 59, 60)')} AS z FROM benchmark WHERE length(text) >= 130),
h AS (SELECT doc_id, {_norm('text')} AS t FROM documents),
p AS (SELECT h.doc_id, b.item_id, strpos(t, a) AS i, a, z, t FROM h JOIN b ON contains(t, a)),
q AS (SELECT *, strpos(substring(t, i + length(a)), z) AS j FROM p)
SELECT doc_id, item_id, 'segmented' AS kind{columns} FROM q WHERE j > 0 AND j - 1 <= {gap}"""


def t2_weak_anchor(spark, sf_dir):
    anchor = F.regexp_replace(F.substring("text", F.lit(1), (F.col("doc_id") % 12 + 1).cast("int")), f"[{SPACE}]+", HOLD)
    return _docs(spark, sf_dir).select("doc_id", scalars.anchor_too_weak(anchor, 4).alias("weak"))


def t2_implicit(spark, sf_dir):
    """Excerpts of the first and last sentences, with nothing that marks what is left out."""
    parts = F.split("text", r"(?<=\.)\s+")
    cut = _t(spark, sf_dir, "benchmark").where(F.size(parts) >= 3).select("item_id", F.concat_ws(" ", parts[0], F.element_at(parts, -1)).alias("text"))
    return locate.locate(_docs(spark, sf_dir), cut, with_preset(implicit_ellipsis=True)).select("doc_id", "item_id", "kind", "index", "length")


def _typos(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.regexp_replace("text", "(?s)(.{14}).", "$1").alias("text"))


def t3_fuzzy(spark, sf_dir):
    found = locate.locate(_docs(spark, sf_dir), _typos(_t(spark, sf_dir, "benchmark")), with_preset(fallbacks=("bitap",)))
    return found.select("doc_id", "item_id", "kind", "index", "length", F.round("score", 6).alias("score"), "via")


def t3_polarity_guard(spark, sf_dir):
    rows = [(1, "He does jump over the old wall.", "He does not jump over the old wall"), (2, "He does not jump over the old wall.", "He does not jmp over the old wall"), (3, "他没有去过北京的故宫", "他有去过北京的故宫")]
    pairs = spark.createDataFrame(rows, "id int, document string, excerpt string")
    return locate.match_pairs(pairs, with_preset(fallbacks=("bitap",), min_fallback_score=0.6)).select("id", "found", "kind")


def match_result(spark, sf_dir):
    """The whole result row of every pair of an excerpt with a document that holds it."""
    docs, items = _docs(spark, sf_dir), _t(spark, sf_dir, "benchmark")
    pairs = locate.exact_pairs(docs, items).select("doc_id", "item_id").join(docs.withColumnRenamed("text", "document"), "doc_id").join(F.broadcast(items.select("item_id", F.col("text").alias("excerpt"))), "item_id")
    return locate.match_pairs(pairs, keys=["doc_id", "item_id"]).select("doc_id", "item_id", "found", "index", "length", "kind", "score", "occurrences", "line", F.md5("source").alias("source_md5"))


def miss_rows(spark, sf_dir):
    """Each item against the document of the same number: a row for every pair, misses included."""
    docs, items = _docs(spark, sf_dir), _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("excerpt"))
    pairs = docs.withColumnRenamed("text", "document").join(items, F.col("doc_id") == F.col("item_id"))
    return locate.match_pairs(pairs, keys=["doc_id", "item_id"]).select("doc_id", "item_id", "found", "kind", "index", "length", "score", "occurrences", "line")


def best_tier(spark, sf_dir):
    """Hits by tier of four renderings of every excerpt."""
    docs, items = _docs(spark, sf_dir), _t(spark, sf_dir, "benchmark").select("item_id", "text")
    out = None
    for name, rows in (("verbatim", items), ("recased", _variant(items)), ("cut", _cut(items)), ("typos", _typos(items))):
        part = locate.locate(docs, rows, with_preset(fallbacks=("bitap",) if name == "typos" else ())).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rendering"), "kind", "n")
        out = part if out is None else out.union(part)
    return out


def preset_matrix(spark, sf_dir):
    """What each preset makes of the same pairs."""
    md = "# Title\n\nSome **bold text** here.\n\nNext para, with tensor_flow and 1_000 more.\n"
    excerpts = [(1, "bold text"), (2, "here. Next para"), (3, "tensor flow"), (4, "next para with tensor_flow"), (5, "1000 more"), (6, "Some bold〔略〕1_000 more")]
    out = None
    for name in ("strict", "default", "loose"):
        pairs = spark.createDataFrame([(name, i, md, e) for i, e in excerpts], "preset string, id int, document string, excerpt string")
        part = locate.match_pairs(pairs, with_preset(name, markdown="commonmark"), keys=["preset", "id"]).select("preset", "id", "found", "kind", "index", "length", "crosses_blocks", "punct_folded")
        out = part if out is None else out.union(part)
    return out


def negation_en(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", negation.negation_count(F.col("text")).cast("long").alias("marks"), negation.negated(F.col("text")).alias("negated"))


def polarity_conflict(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", negation.negations_conflict(F.col("text"), F.concat(F.lit("Never "), F.col("text"))).alias("conflict"))


def script_profile(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *[v.cast("long").alias(k) for k, v in scalars.script_counts(F.col("text")).items()])


def space_between(spark, sf_dir):
    """Whether the space between two neighbours may go, for all pairs around spaces in the inline texts and the conversations."""
    turns = _t(spark, sf_dir, "conversations").select((-F.col("conv_id") * 1000 - F.col("turn") - 1).cast("long").alias("id"), "text")
    texts = _inline(spark).select(F.col("id").cast("long").alias("id"), "text").union(turns)
    pairs = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S(?= +\S)"), F.lit(0))).alias("k", "a"), "text")
    right = F.regexp_extract_all("text", F.lit(r"\S +(?=(\S))"), F.lit(1))
    pairs = pairs.select("id", "k", "a", F.get(right, F.col("k")).alias("b"))
    left, after = scalars.script_of(F.col("a")), scalars.script_of(F.col("b"))
    return pairs.select("id", "k", "a", "b", left.alias("script"), scalars.can_drop_space_between(left, after).alias("droppable"))


def tokenize_char(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(scalars.tokens(F.col("text"), "char")).cast("long").alias("n"))


def tokenize_word(spark, sf_dir):
    t = scalars.tokens(F.col("text"), "word")
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), scalars.word_count(t).cast("long").alias("n_words"))


def grapheme_count(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("long").alias("id"), "text").union(_inline(spark).select((-F.col("id")).cast("long").alias("id"), "text"))
    return docs.select("id", scalars.graphemes(F.col("text")).cast("long").alias("graphemes"))


def line_number(spark, sf_dir):
    half = (F.length("text") / 2).cast("int")
    return _docs(spark, sf_dir).select("doc_id", scalars.line_of(F.col("text"), half).cast("long").alias("line"))


def utf16_offset(spark, sf_dir):
    return _inline(spark).select("id", scalars.utf16_offset(F.col("text"), F.length("text")).cast("long").alias("units"))


def norm_number_grouping(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    shown = F.concat(F.lit("total "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)") * 1000, 2), F.lit(", order "), F.col("o_orderkey").cast("string"))
    return orders.select("o_orderkey", scalars.strip_grouping(shown).alias("norm"))


def norm_identifiers(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", scalars.normalize_separators(F.col("url")).alias("norm"), scalars.normalize_identifier(F.col("url")).alias("spelled"))


def identifier_breaks(spark, sf_dir):
    found = scalars.identifier_breaks(F.col("url"))
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    return _t(spark, sf_dir, "pages").select("page_id", count("insert").alias("inserts"), count("replace").alias("replaces"))


def norm_width(spark, sf_dir):
    wide = F.translate("text", ASCII, FULL_WIDTH)
    return _docs(spark, sf_dir).select("doc_id", _digest("norm_md5", to_column(wide, [Table(width_table())])))


def norm_zero_width(spark, sf_dir):
    spoilt = F.replace(F.col("text"), F.lit("e"), F.lit("e​­"))
    return _docs(spark, sf_dir).select("doc_id", _digest("norm_md5", to_column(spoilt, [Sub(f"[{ZERO_WIDTH}]", "")])))


def split_segments(spark, sf_dir):
    return semantic.split_segments(_docs(spark, sf_dir)).select("doc_id", F.col("seg_index").cast("long").alias("seg_index"), F.col("start").cast("long").alias("start"), _digest("segment_md5", F.col("segment")))


_SEGMENTS_SQL = f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{semantic.SEGMENT.replace(HOLD, chr(92) + "x01")}', 0) AS w, regexp_extract_all(text, '{semantic.SEGMENT.replace(HOLD, chr(92) + "x01")}', 1) AS o FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, unnest(o) AS o, generate_subscripts(w, 1) AS k FROM m),
a AS (SELECT doc_id, k, o, CAST(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - length(o) AS place FROM u),
c AS (SELECT doc_id, place, o, unnest(range(0, greatest(1, CAST(ceil(length(o) / 300.0) AS BIGINT)))) AS p FROM a WHERE o <> ''),
seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place + p * 300) - 1 AS seg_index, place + p * 300 AS start, substring(o, CAST(p * 300 + 1 AS BIGINT), 300) AS segment FROM c)"""


def _paraphrased(benchmark: DataFrame) -> DataFrame:
    """Every third word left out, which no exact tier forgives."""
    return benchmark.select("item_id", F.array_join(F.filter(F.split("text", " "), lambda w, k: k % 3 != 2), " ").alias("text"))


def _recalled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The best segments of the whole corpus for every paraphrased excerpt."""
    docs, items = _docs(spark, sf_dir), _paraphrased(_t(spark, sf_dir, "benchmark"))
    return docs, semantic.recall_corpus(docs, items.select("item_id", F.col("text").alias("excerpt")))


def recall_overlap_topk(spark, sf_dir):
    return _recalled(spark, sf_dir)[1].select("doc_id", "item_id", F.col("seg_index").cast("long").alias("seg_index"), F.col("recall_rank").cast("long").alias("recall_rank"), F.round("recall_score", 9).alias("recall_score"))


def minmax_scores(spark, sf_dir):
    return semantic.normalize_scores(_recalled(spark, sf_dir)[1], by=("item_id",)).select("doc_id", "item_id", F.col("recall_rank").cast("long").alias("recall_rank"), F.round("norm_score", 9).alias("norm_score"))


def segment_fallback(spark, sf_dir):
    return semantic.segment_fallback(_recalled(spark, sf_dir)[1], by=("item_id",)).select("doc_id", "item_id", F.col("seg_index").cast("long").alias("seg_index"), F.round("score", 9).alias("score"))


def t4_aligned(spark, sf_dir):
    """Excerpts and paraphrases of them: hits of the exact tiers, and recall with alignment for those that have none."""
    docs, items = _docs(spark, sf_dir), _t(spark, sf_dir, "benchmark").select("item_id", "text")
    both = items.union(_paraphrased(items).select(-F.col("item_id") - 1, "text"))
    return semantic.locate_or_recall(docs, both).select("doc_id", "item_id", "kind", "via", "index", "length", F.round("score", 6).alias("score"))


_RECALL_SQL = _SEGMENTS_SQL + f""",
e AS (SELECT item_id, array_to_string(list_filter(string_split(text, ' '), lambda w, k: k % 3 <> 0), ' ') AS excerpt FROM benchmark WHERE text IS NOT NULL),
x AS (SELECT item_id, excerpt, {_negations_sql('excerpt')} % 2 AS odd FROM e),
ec AS (SELECT item_id, c, count(*) AS n FROM (SELECT item_id, unnest(string_split(excerpt, '')) AS c FROM e) GROUP BY item_id, c),
sc AS (SELECT DISTINCT doc_id, seg_index, c FROM (SELECT doc_id, seg_index, unnest(string_split(segment, '')) AS c FROM seg)),
mt AS (SELECT ec.item_id, sc.doc_id, sc.seg_index, sum(ec.n) AS n FROM sc JOIN ec ON sc.c = ec.c GROUP BY ALL),
r AS (SELECT mt.*, CAST(n AS DOUBLE) / length(x.excerpt) AS recall_score, x.odd FROM mt JOIN x ON mt.item_id = x.item_id WHERE 2 * n >= length(x.excerpt)),
sp AS (SELECT doc_id, seg_index, {_negations_sql('segment')} % 2 AS odd FROM seg),
k AS (SELECT r.*, row_number() OVER (PARTITION BY item_id ORDER BY recall_score DESC, r.doc_id, r.seg_index) - 1 AS recall_rank FROM r JOIN sp ON r.doc_id = sp.doc_id AND r.seg_index = sp.seg_index AND r.odd = sp.odd),
t AS (SELECT *, min(recall_score) OVER p AS low, max(recall_score) OVER p AS high FROM k WHERE recall_rank < 3 WINDOW p AS (PARTITION BY item_id)),
n AS (SELECT *, CASE WHEN high = low THEN 1.0 ELSE (recall_score - low) / (high - low) END AS norm_score FROM t)"""


def _markup(spark, sf_dir) -> DataFrame:
    """Documents as markdown: the first line a heading, every other line a paragraph with its first word in bold."""
    lines = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N} .,\n]", ""), "\n"), lambda s: F.trim(s) != "")
    lines = F.transform(lines, lambda s: F.trim(s))
    para = F.transform(lines, lambda s: F.concat(F.lit("**"), F.regexp_extract(s, r"^\S+", 0), F.lit("**"), F.regexp_replace(s, r"^\S+", "")))
    plain = F.array_join(lines, "\n")
    return _docs(spark, sf_dir).where(F.size(lines) > 0).select("doc_id", F.concat(F.lit("# "), F.array_join(para, "\n\n")).alias("md"), plain.alias("plain"), F.size(lines).alias("n_lines"))


def _flattened(frame: DataFrame, kind: str) -> DataFrame:
    import pyarrow as pa

    from ..functions.markdown import FLATTENERS

    def run(source):
        for b in source:
            flats = [FLATTENERS[kind](t) for t in b.column("md").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f.text for f in flats], pa.string()), pa.array([len(f.blocks) for f in flats], pa.int64()), pa.array([len(f.constructs) for f in flats], pa.int64())], names=["doc_id", "text", "n_blocks", "n_constructs"])

    return frame.select("doc_id", "md").mapInArrow(run, "doc_id bigint, text string, n_blocks bigint, n_constructs bigint")


def md_blocks(spark, sf_dir):
    return _flattened(_markup(spark, sf_dir), "commonmark").select("doc_id", "n_blocks", "n_constructs", _digest("text_md5", F.rtrim(F.regexp_replace("text", r"\n+$", ""))))


def md_flatten_regex(spark, sf_dir):
    return _flattened(_markup(spark, sf_dir), "regex").select("doc_id", "n_blocks", _digest("text_md5", F.regexp_replace("text", r"\n+", "\n")))


_LINES_SQL = "list_filter(list_transform(string_split(regexp_replace(text, '[^\\p{L}\\p{N} .,\\n]', '', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"


def cross_block(spark, sf_dir):
    md = "# One\n\nAlpha beta gamma.\n\n> Delta epsilon.\n\n- zeta eta\n- theta iota\n"
    excerpts = [(1, "beta gamma. Delta"), (2, "gamma.\nDelta epsilon.\nzeta"), (3, "One Alpha"), (4, "epsilon. theta"), (5, "zeta eta theta")]
    pairs = spark.createDataFrame([(i, md, e) for i, e in excerpts], "id int, document string, excerpt string")
    out = locate.match_pairs(pairs, with_preset(markdown="commonmark"), keys=["id"]).select(F.lit("any").alias("limit"), "id", "found", "kind", "crosses_blocks", "index", "length")
    two = locate.match_pairs(pairs, with_preset(markdown="commonmark", max_cross_blocks=2), keys=["id"]).select(F.lit("two").alias("limit"), "id", "found", "kind", "crosses_blocks", "index", "length")
    return out.union(two)


def visible_of_markup(spark, sf_dir):
    """What a reader sees of whole documents that are written with headings, quotes, emphasis, code and links."""
    import pyarrow as pa

    from ..operators.pairs import visible_text

    lines = F.transform(F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N} .,\n]", ""), "\n"), lambda s: F.trim(s) != ""), lambda s: F.trim(s))
    first, rest = (lambda s: F.regexp_extract(s, r"^\S+", 0)), (lambda s: F.regexp_replace(s, r"^\S+", ""))
    ways = [("**", "**"), ("`", "`"), ("[", "](http://a.b/c)"), ("> *", "*"), ("## ", "")]
    dress = lambda s, k: F.element_at(F.array(*[F.concat(F.lit(a), first(s), F.lit(z), rest(s)) for a, z in ways]), (k % len(ways) + 1).cast("int"))
    md = _docs(spark, sf_dir).where(F.size(lines) > 0).select("doc_id", F.array_join(F.transform(lines, dress), "\n\n").alias("md"))
    o = with_preset(markdown="commonmark")

    def run(source):
        for b in source:
            shown = [visible_text(t, o) for t in b.column("md").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shown, pa.string())], names=["doc_id", "shown"])

    return md.mapInArrow(run, "doc_id bigint, shown string").select("doc_id", _digest("shown_md5", F.col("shown")))


def t3_multi_hit(spark, sf_dir):
    """Up to three places in each passage, said three times over, of the passage with some characters left out."""
    import pyarrow as pa

    from ..functions.approx import find

    rows = _t(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.concat_ws(" ~~~~ ", "text", "text", "text").alias("hay"), F.regexp_replace("text", "(?s)(.{14}).", "$1").alias("needle"), F.length("text").alias("n"))

    def run(source):
        for b in source:
            out = []
            for i, hay, needle, n in zip(*(b.column(c).to_pylist() for c in ("item_id", "hay", "needle", "n"))):
                out += [(i, k) for k in sorted((c.start + n // 2) // (n + 6) for c in find(needle, hay, most=3, least=0.9))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], names=["item_id", "copy"])

    return rows.mapInArrow(run, "item_id bigint, copy bigint")


_LOWER = [Lower()]
_IGNORE = with_preset(ignore_punctuation=True, ellipsis=False, ignore_width=False, number_grouping=False)
norm_case = _mapped(_LOWER)
norm_whitespace = _mapped([Sub(f"[{SPACE}]+", HOLD)])
norm_punct_glyphs = _mapped([punctuation_table()])
norm_camel = _mapped([camel_rule()])
norm_separators = _mapped([separators_rule()])
norm_full = _mapped(rules(with_preset()))
ignore_punct_fold = _mapped(rules(_IGNORE))
ignore_punct_drop = _mapped(rules(replace(_IGNORE, ignore_punctuation="drop")))
ignore_punct_symbols = _mapped(rules(replace(_IGNORE, punctuation_class=r"[\p{P}\p{S}]", ignore_punctuation="drop")))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        t0_exact_locate, t0_occurrences, t0_native_join, t0_earliest, t1_normalized_locate, t2_segmented, t2_gap_guard, t2_weak_anchor, t2_implicit, t3_fuzzy, t3_multi_hit, t3_polarity_guard, match_result, miss_rows, best_tier,
        preset_matrix, negation_en, polarity_conflict, script_profile, space_between, tokenize_char, tokenize_word, grapheme_count, line_number, utf16_offset, norm_number_grouping,
        norm_identifiers, identifier_breaks, norm_width, norm_zero_width, split_segments, recall_overlap_topk, minmax_scores, segment_fallback, t4_aligned, md_blocks, md_flatten_regex, cross_block, visible_of_markup,
    )
} | {
    "norm_case": norm_case, "norm_whitespace": norm_whitespace, "norm_punct_glyphs": norm_punct_glyphs, "norm_camel": norm_camel, "norm_separators": norm_separators, "norm_full": norm_full,
    "ignore_punct_fold": ignore_punct_fold, "ignore_punct_drop": ignore_punct_drop, "ignore_punct_symbols": ignore_punct_symbols,
}


def _md5(x: str, name: str = "norm_md5") -> str:
    return f"SELECT doc_id, md5({x}) AS {name} FROM documents"


_RANGES_SQL = {"digit": "0-9", "thai": "\\x{e00}-\\x{e7f}", "kana": "\\x{3040}-\\x{30ff}", "han": "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}", "hangul": "\\x{ac00}-\\x{d7af}", "latin": "A-Za-z\\x{c0}-\\x{24f}"}


def _without(signs: str) -> str:
    folded = _glyphs("lower(text)")
    return f"regexp_replace(regexp_replace({folded}, '{signs}', '', 'g'), '{_SPACE_SQL}', '', 'g')"


_FOLD_SQL = _dropped(_held(f"regexp_replace({_glyphs('lower(text)')}, '\\p{{P}}', chr(1), 'g')"))
_SEPARATED = "regexp_replace(regexp_replace({x}, '([A-Za-z0-9])[-_\\x{{2010}}-\\x{{2015}}\\x{{2212}}]([A-Za-z0-9])', '\\1{to}\\2', 'g'), '([A-Za-z0-9])[-_\\x{{2010}}-\\x{{2015}}\\x{{2212}}]([A-Za-z0-9])', '\\1{to}\\2', 'g')"
_CAMEL = "regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
_PLAIN_MD = f"array_to_string({_LINES_SQL}, chr(10))"

ORACLES: dict[str, str] = {
    "t0_exact_locate": f"WITH h AS ({_HITS_SQL}) SELECT doc_id, item_id, 'exact' AS kind, cp_index + {_WIDE_SQL.format(x='substring(doc, 1, cp_index)')} AS index, length(needle) + {_WIDE_SQL.format(x='needle')} AS length, cp_index, length(needle) AS cp_length, {_COUNT_SQL} AS occurrences, 1 + length(substring(doc, 1, cp_index)) - length(replace(substring(doc, 1, cp_index), chr(10), '')) AS line FROM h",
    "t0_occurrences": f"WITH h AS ({_HITS_SQL}) SELECT doc_id, item_id, cp_index, {_COUNT_SQL} AS occurrences FROM h",
    "t0_native_join": f"WITH h AS ({_HITS_SQL}) SELECT doc_id, item_id, cp_index, {_COUNT_SQL} AS occurrences FROM h",
    "t0_earliest": f"WITH h AS ({_HITS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cp_index, doc_id) AS k, count(*) OVER (PARTITION BY item_id) AS n_docs FROM h) SELECT item_id, cp_index, doc_id, n_docs FROM r WHERE k = 1",
    "t1_normalized_locate": f"WITH h AS (SELECT doc_id, {_norm('text')} AS doc FROM documents), b AS (SELECT item_id, {_norm(_UPPER_SQL)} AS needle FROM benchmark) SELECT doc_id, item_id, strpos(doc, needle) - 1 AS cp_index, {_COUNT_SQL} AS occurrences FROM h JOIN b ON contains(doc, needle)",
    "t2_segmented": _cut_sql("1000000000", ", 1 AS occurrences, 1.0 AS score"),
    "t2_gap_guard": _cut_sql("60", ""),
    "t2_weak_anchor": f"WITH a AS (SELECT doc_id, {_held('substring(text, 1, CAST(doc_id % 12 + 1 AS INTEGER))')} AS a FROM documents) SELECT doc_id, length(replace(a, chr(1), '')) < 4 AND (NOT contains(a, chr(1)) OR len(list_filter(string_split(a, chr(1)), lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))) < 2) AS weak FROM a",
    "match_result": f"WITH h AS ({_HITS_SQL}) SELECT doc_id, item_id, true AS found, cp_index + {_WIDE_SQL.format(x='substring(doc, 1, cp_index)')} AS index, length(needle) + {_WIDE_SQL.format(x='needle')} AS length, 'exact' AS kind, 1.0 AS score, {_COUNT_SQL} AS occurrences, 1 + length(substring(doc, 1, cp_index)) - length(replace(substring(doc, 1, cp_index), chr(10), '')) AS line, md5(needle) AS source_md5 FROM h",
    "miss_rows": "SELECT d.doc_id, b.item_id, contains(d.text, b.text) AS found, CASE WHEN contains(d.text, b.text) THEN 'exact' ELSE 'none' END AS kind, strpos(d.text, b.text) - 1 AS index, CASE WHEN contains(d.text, b.text) THEN length(b.text) ELSE 0 END AS length, CASE WHEN contains(d.text, b.text) THEN 1.0 ELSE 0.0 END AS score, CASE WHEN contains(d.text, b.text) THEN 1 ELSE 0 END AS occurrences, CASE WHEN contains(d.text, b.text) THEN 1 + length(substring(d.text, 1, strpos(d.text, b.text) - 1)) - length(replace(substring(d.text, 1, strpos(d.text, b.text) - 1), chr(10), '')) ELSE -1 END AS line FROM documents d JOIN benchmark b ON d.doc_id = b.item_id",
    "negation_en": f"SELECT doc_id, {_negations_sql('text')} AS marks, {_negations_sql('text')} % 2 = 1 AS negated FROM documents",
    "polarity_conflict": f"SELECT conv_id, turn, ({_negations_sql('text')}) % 2 <> ({_negations_sql(chr(39) + 'Never ' + chr(39) + ' || text')}) % 2 AS conflict FROM conversations",
    "script_profile": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(substring(text, 1, 2000), '[{r}]')) AS {n}" for n, r in (("han", "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}"), ("kana", "\\x{3040}-\\x{30ff}"), ("hangul", "\\x{ac00}-\\x{d7af}"), ("thai", "\\x{e00}-\\x{e7f}"), ("latin", "A-Za-z\\x{c0}-\\x{24f}"))) + " FROM documents",
    "tokenize_char": "SELECT doc_id, length(text) AS n FROM documents",
    "tokenize_word": f"SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN_SQL}')) AS n_tokens, len(list_filter(regexp_extract_all(text, '{_TOKEN_SQL}'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) AS n_words FROM documents",
    "grapheme_count": f"SELECT doc_id AS id, length_grapheme(text) AS graphemes FROM documents UNION ALL SELECT -id, length_grapheme(text) FROM {_values()}",
    "line_number": "WITH h AS (SELECT doc_id, substring(text, 1, CAST(floor(length(text) / 2.0) AS INTEGER)) AS t FROM documents) SELECT doc_id, 1 + length(t) - length(replace(t, chr(10), '')) AS line FROM h",
    "utf16_offset": f"SELECT id, length(text) + {_WIDE_SQL.format(x='text')} AS units FROM {_values()}",
    "norm_number_grouping": "SELECT o_orderkey, 'total ' || replace(format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1000 AS DOUBLE)), ',', '') || ', order ' || CAST(o_orderkey AS VARCHAR) AS norm FROM orders",
    "norm_identifiers": f"SELECT page_id, {_SEPARATED.format(x='url', to=' ')} AS norm, {_CAMEL.format(x=_SEPARATED.format(x='url', to=' '))} AS spelled FROM pages",
    "identifier_breaks": f"SELECT page_id, len(regexp_extract_all(url, '[a-z0-9][A-Z]')) AS inserts, len(regexp_extract_all({_SEPARATED.format(x='url', to='~~')}, '~~')) - len(regexp_extract_all(url, '~~')) AS replaces FROM pages",
    "norm_width": _md5(f"translate(translate(text, {_q(ASCII)}, {_q(FULL_WIDTH)}), {_q(FULL_WIDTH)}, {_q(ASCII)})"),
    "norm_zero_width": _md5(f"regexp_replace(replace(text, 'e', 'e' || chr(8203) || chr(173)), '{_ZERO_SQL}', '', 'g')"),
    "split_segments": _SEGMENTS_SQL + " SELECT doc_id, seg_index, start, md5(segment) AS segment_md5 FROM seg",
    "recall_overlap_topk": _RECALL_SQL + " SELECT doc_id, item_id, seg_index, recall_rank, round(recall_score, 9) AS recall_score FROM t",
    "minmax_scores": _RECALL_SQL + " SELECT doc_id, item_id, recall_rank, round(norm_score, 9) AS norm_score FROM n",
    "segment_fallback": _RECALL_SQL + " SELECT doc_id, item_id, seg_index, round(norm_score * 0.9, 9) AS score FROM n WHERE recall_rank = 0",
    "md_blocks": f"SELECT doc_id, len({_LINES_SQL}) AS n_blocks, len({_LINES_SQL}) AS n_constructs, md5({_PLAIN_MD}) AS text_md5 FROM documents WHERE len({_LINES_SQL}) > 0",
    "md_flatten_regex": f"SELECT doc_id, 1 AS n_blocks, md5({_PLAIN_MD}) AS text_md5 FROM documents WHERE len({_LINES_SQL}) > 0",
    "norm_case": _md5("lower(text)"),
    "norm_whitespace": _md5(_held("text")),
    "norm_punct_glyphs": _md5(_glyphs("text")),
    "norm_camel": _md5(_CAMEL.format(x="text")),
    "norm_separators": _md5(_SEPARATED.format(x="text", to=" ")),
    "norm_full": _md5(_norm("text")),
    "ignore_punct_fold": _md5(_FOLD_SQL),
    "ignore_punct_drop": _md5(_without("\\p{P}")),
    "ignore_punct_symbols": _md5(_without("[\\p{P}\\p{S}]")),
    "t3_polarity_guard": "SELECT * FROM (VALUES (1, false, 'none'), (2, true, 'fuzzy'), (3, false, 'none')) AS v(id, found, kind)",
    "space_between": "WITH t AS (SELECT CAST(id AS BIGINT) AS id, text FROM " + _values() + " UNION ALL SELECT -conv_id * 1000 - turn - 1, text FROM conversations), "
    "m AS (SELECT id, regexp_extract_all(text, '(\\S) +\\S', 1) AS x, regexp_split_to_array(text, ' +') AS w FROM t), "
    "u AS (SELECT id, unnest(w) AS p, generate_subscripts(w, 1) AS i, len(w) AS n FROM m), v AS (SELECT id, i, right(p, 1) AS a, left(lead(p) OVER (PARTITION BY id ORDER BY i), 1) AS b FROM u), "
    "f AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k, a, b FROM v WHERE regexp_matches(a, '\\S') AND regexp_matches(b, '\\S')), "
    "c AS (SELECT *, " + ", ".join("CASE " + " ".join(f"WHEN regexp_matches({x}, '^[{r}]') THEN '{n}'" for n, r in _RANGES_SQL.items()) + f" ELSE 'other' END AS {y}" for x, y in (("a", "script"), ("b", "other_script"))) + " FROM f) "
    "SELECT id, k, a, b, script, script <> 'other' AND other_script <> 'other' AND (script <> other_script OR script IN ('han', 'kana')) AS droppable FROM c",
    "visible_of_markup": f"SELECT doc_id, md5({_PLAIN_MD}) AS shown_md5 FROM documents WHERE len({_LINES_SQL}) > 0",
    "t3_multi_hit": "SELECT item_id, unnest(range(3)) AS copy FROM benchmark WHERE text <> ''",
}
