"""Queries of normalisation, scripts, negation and spans, over the tables and over strings generated from their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import negation, particles, scalars
from ..functions.rules import HOLD, SPACE, Sub, space_rules, to_column, trace
from ..operators.locate import match_pairs, parallel
from ..operators.pairs import normalize, snapped
from ..options import with_preset
from ..sources import hits, misses, prepare
from .queries import _RANGES_SQL, _SPACE_SQL, ROWS, _digest, _docs, _inline, _norm, _negations_sql, _q, _t, _values

#: Signs that generated strings are made of: those of the lexicons, and neighbours of all scripts with spaces between.
NEGATION_SIGNS = "".join(sorted({c for w in negation.CHINESE_NEGATION_WORDS | negation.CHINESE_NON_NEGATION_WORDS for c in w})) + "我去"
PARTICLE_SIGNS = "".join(sorted({c for w in particles.SOLID_WORDS for c in w})) + "的地得" * 12
SCRIPT_SIGNS = "中文あア한국ไทaé17.  　    "
#: Rows of ``snap_span`` that a worker hands on at once, or those of one text.
SPAN_ROWS = 1 << 18
LOCALES = ("zh", "ZH-tw", "ja", "ko", "th", "en", "fr", "zh-Hant")


def _generated(spark, sf_dir: str, signs: str, n: int = 12) -> DataFrame:
    """The inline texts under negative ids, and a string of ``n`` signs for every order, drawn by its key."""
    pick = lambda j: F.substring(F.lit(signs), (F.pmod(F.col("o_orderkey") * (j * j + 7) + F.col("o_custkey") * (j + 1) + j * 31, F.lit(len(signs))) + 1).cast("int"), F.lit(1))
    drawn = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.concat(*[pick(j) for j in range(n)]).alias("text"))
    return drawn.union(_inline(spark).select((-F.col("id")).cast("long").alias("id"), "text"))


def _generated_sql(signs: str, n: int = 12) -> str:
    drawn = " || ".join(f"substring({_q(signs)}, CAST((o_orderkey * {j * j + 7} + o_custkey * {j + 1} + {j * 31}) % {len(signs)} + 1 AS INTEGER), 1)" for j in range(n))
    return f"(SELECT CAST(o_orderkey AS BIGINT) AS id, {drawn} AS text FROM orders UNION ALL SELECT CAST(-id AS BIGINT), text FROM {_values()}) AS g"


def negation_zh(spark, sf_dir):
    return _generated(spark, sf_dir, NEGATION_SIGNS).select("id", negation.negation_count(F.col("text")).cast("long").alias("marks"))


def lexicon_merge(spark, sf_dir):
    """Marks once words are added: a new negation loses its protection, and a new protected word is no negation."""
    marks = negation.negation_count(F.col("text"), ("无限", "我去", "非常"), ("没有", "未来", "我去"))
    return _generated(spark, sf_dir, NEGATION_SIGNS).select("id", marks.cast("long").alias("marks"))


def particle_fold(spark, sf_dir):
    return _generated(spark, sf_dir, PARTICLE_SIGNS).select("id", particles.fold_particles(F.col("text")).alias("folded"))


def norm_space_by_script(spark, sf_dir):
    return _generated(spark, sf_dir, SCRIPT_SIGNS, 16).select("id", to_column(F.col("text"), [Sub(f"[{SPACE}]+", HOLD), *space_rules()]).alias("norm"))


def lang_profile(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("long").alias("id"), F.lit("documents").alias("origin"), "text")
    return docs.union(_generated(spark, sf_dir, SCRIPT_SIGNS, 16).select("id", F.lit("generated"), "text")).select("id", "origin", scalars.language_profile(F.col("text")).alias("profile"))


def locale_profile(spark, sf_dir):
    """The profile of a locale: the name itself, its base language, or the default one with that locale."""
    name = F.concat(F.element_at(F.array(*map(F.lit, LOCALES)), (F.col("c_custkey") % len(LOCALES) + 1).cast("int")), F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("-N"), F.col("c_nationkey").cast("string"))).otherwise(""))
    profile = scalars.profile_of_locale(F.col("locale"))
    return _t(spark, sf_dir, "customer").select("c_custkey", name.alias("locale")).select("c_custkey", "locale", profile["id"].alias("profile"), profile["granularity"].alias("granularity"), profile["locale"].alias("segmenter"))


def norm_numerals(spark, sf_dir):
    """Numbers in Chinese numerals, by units, by sections, digit by digit, signed and with decimals, as digits."""
    import pyarrow as pa

    o = with_preset(cjk_numerals=True, number_grouping=False)
    digit = lambda x: F.translate(x.cast("string"), "0123456789", "零一二三四五六七八九")
    key = F.col("o_orderkey")
    a, b, c, d = ((key + j) % 9 + 1 for j in (0, 3, 5, 7))
    units = F.concat(digit(a), F.lit("千"), digit(b), F.lit("百"), digit(c), F.lit("十"), digit(d))
    forms = F.concat(F.lit("x"), units, F.lit("y"), digit(b), F.lit("万"), units, F.lit("z"), digit(key), F.lit(" 负"), digit(c), F.lit("点"), digit(a), digit(d), F.lit("w"))

    def run(source):
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column("o_orderkey"), pa.array([normalize(t, o).text for t in batch.column("text").to_pylist()], pa.string())], names=["o_orderkey", "norm"])

    return _t(spark, sf_dir, "orders").select(key.cast("long").alias("o_orderkey"), forms.alias("text")).mapInArrow(run, "o_orderkey bigint, norm string")


def grouped_digits(spark, sf_dir):
    """The grouped digits at the start of a formatted number, by the pattern made for the separators; none without any."""
    shown = F.format_number(F.col("o_totalprice").cast("decimal(18,2)") * 1000, 2)
    found = lambda signs: F.regexp_extract(shown, scalars.grouped_digits_pattern(signs), 0)
    return _t(spark, sf_dir, "orders").select("o_orderkey", found(",").alias("grouped"), found("").alias("never"))


def norm_spans(spark, sf_dir):
    """Sums of the source intervals of all characters of a text whose runs of spaces are folded."""
    import pyarrow as pa

    def run(source):
        for b in source:
            found = [trace(t or "", [Sub(f"[{SPACE}]+", HOLD)]) for t in b.column("text").to_pylist()]
            columns = ([len(x.text) for x in found], [int(x.start.sum()) for x in found], [int(x.end.sum()) for x in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_chars", "starts", "ends"])

    return _docs(spark, sf_dir).mapInArrow(run, "doc_id bigint, n_chars bigint, starts bigint, ends bigint")


def snap_span(spark, sf_dir):
    """Every single code point of the inline texts and the conversations, widened to its grapheme cluster."""
    import numpy as np
    import pyarrow as pa

    turns = parallel(_t(spark, sf_dir, "conversations").select((-F.col("conv_id") * 1000 - F.col("turn") - 1).cast("long").alias("id"), "text"))

    def made(ids, at: list[int], spans: list) -> pa.RecordBatch:
        sizes = [len(lo) for lo, _ in spans]
        columns = ([np.arange(n) for n in sizes], *zip(*spans))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(at, sizes))), *(pa.array(np.concatenate(c), pa.int64()) for c in columns)], names=["id", "cp", "lo", "hi"])

    def run(source):
        for b in source:
            at, spans, size = [], [], 0
            for row, t in enumerate(b.column("text").to_pylist()):
                if t:
                    at.append(row)
                    spans.append(snapped(t))
                    size += len(t)
                if size >= SPAN_ROWS:
                    yield made(b.column("id"), at, spans)
                    at, spans, size = [], [], 0
            if at:
                yield made(b.column("id"), at, spans)

    return _inline(spark).select(F.col("id").cast("long").alias("id"), "text").union(turns).mapInArrow(run, "id bigint, cp bigint, lo bigint, hi bigint")


def prepared_index(spark, sf_dir):
    """The index of a corpus in which every row comes twice: one row an id."""
    docs = _docs(spark, sf_dir)
    return prepare(docs.union(docs)).select("doc_id", _digest("text_md5", F.col("text")), _digest("norm_md5", F.col("norm")))


def _items(spark, sf_dir) -> DataFrame:
    """Each item with itself, with the next item's text, and with its text after other words."""
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    both = items.join(after, "item_id", "left")
    pairs: list[tuple[str, Column]] = [("self", F.col("text")), ("next", F.coalesce("other", F.lit(""))), ("late", F.concat(F.lit("And so. "), F.col("text")))]
    out = None
    for name, document in pairs:
        part = both.select(F.lit(name).alias("kind_of_pair"), "item_id", document.alias("document"), F.col("text").alias("excerpt"))
        out = part if out is None else out.union(part)
    return out


def routed(spark, sf_dir):
    """What goes to the sink of hits and to that of misses."""
    found = match_pairs(_items(spark, sf_dir), keys=["kind_of_pair", "item_id"])
    return hits(found).select(F.lit("hits").alias("sink"), "kind_of_pair", "item_id", "index", "line").union(misses(found).select(F.lit("misses"), "kind_of_pair", "item_id", "index", "line"))


def punct_folded(spark, sf_dir):
    """Every document sought in itself with its full stops made exclamation marks: found, and told apart by punctuation."""
    o = with_preset(ignore_punctuation=True, ellipsis=False)
    pairs = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("document"), F.translate("text", ".", "!").alias("excerpt"))
    return match_pairs(pairs, o, keys=["doc_id"]).select("doc_id", "kind", F.coalesce("punct_folded", F.lit(False)).alias("punct_folded"))


def negation_places(spark, sf_dir):
    """Number and least place of the marks that hit rows are judged by, against the count by native expressions."""
    import pyarrow as pa

    def run(source):
        for b in source:
            found = [negation.detect_negation(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in found], pa.int64())], names=["doc_id", "marks"])

    return _docs(spark, sf_dir).mapInArrow(run, "doc_id bigint, marks bigint")


QUERIES = {f.__name__: f for f in (negation_zh, lexicon_merge, particle_fold, norm_space_by_script, lang_profile, locale_profile, norm_numerals, grouped_digits, norm_spans, snap_span, prepared_index, routed, punct_folded, negation_places)}


def _marks_sql(protected: set[str], words: set[str]) -> str:
    """Marks of a text by a walk from the left: at each place the longest protected word, else the longest negation, is taken."""
    listed = lambda ws: "[" + ", ".join(_q(w) for w in sorted(ws, key=lambda w: (-len(w), w))) + "]"
    return (
        f"WITH RECURSIVE l AS (SELECT {listed(protected)} AS p, {listed(words)} AS n), "
        f"s AS (SELECT id, text, CAST(1 AS BIGINT) AS spot, CAST(0 AS BIGINT) AS marks FROM {_generated_sql(NEGATION_SIGNS)} UNION ALL "
        "SELECT id, text, spot + CASE WHEN a IS NOT NULL THEN length(a) WHEN b IS NOT NULL THEN length(b) ELSE 1 END, marks + CASE WHEN a IS NULL AND b IS NOT NULL THEN 1 ELSE 0 END FROM "
        "(SELECT s.*, list_filter(l.p, lambda w: substring(text, spot, length(w)) = w)[1] AS a, list_filter(l.n, lambda w: substring(text, spot, length(w)) = w)[1] AS b FROM s, l WHERE spot <= length(text))) "
        f"SELECT id, max(marks) + any_value({_negations_sql('text')}) AS marks FROM s GROUP BY id"
    )


_NO, _YES = set(negation.CHINESE_NEGATION_WORDS), set(negation.CHINESE_NON_NEGATION_WORDS)
_COVERS = "[" + ", ".join(f"{{'w': {_q(w)}, 'o': {i}}}" for w in particles.SOLID_WORDS for i, c in enumerate(w) if c in particles.PARTICLES) + "]"
_SCRIPT = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, '^[{r}]') THEN '{n}'" for n, r in _RANGES_SQL.items()) + " ELSE 'other' END"
_SHARE = lambda s: f"len(regexp_extract_all(head, '[{_RANGES_SQL[s]}]'))"
_ALL = " + ".join(_SHARE(s) for s in ("han", "kana", "hangul", "thai", "latin"))
_IS = lambda s: f"({_SHARE(s)}) >= 0.15 * ({_ALL})"
_PRICE = "format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1000 AS DOUBLE))"
_D = lambda j: f"((o_orderkey + {j}) % 9 + 1)"
_UNITS = f"CAST({_D(0)} * 1000 + {_D(3)} * 100 + {_D(5)} * 10 + {_D(7)} AS VARCHAR)"

ORACLES = {
    "negation_zh": _marks_sql(_YES, _NO),
    "lexicon_merge": _marks_sql((_YES - {"无限", "我去", "非常"}) | {"没有", "未来", "我去"}, (_NO | {"无限", "非常"}) - {"没有"}),
    "particle_fold": f"WITH c AS (SELECT {_COVERS} AS covers) SELECT id, coalesce(array_to_string(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN substring(text, i, 1) IN ('的', '地', '得') "
    f"AND len(list_filter(covers, lambda x: i > x.o AND substring(text, i - x.o, length(x.w)) = x.w)) = 0 THEN '的' ELSE substring(text, i, 1) END), ''), '') AS folded FROM {_generated_sql(PARTICLE_SIGNS)}, c",
    "norm_space_by_script": f"WITH w AS (SELECT id, regexp_split_to_array(regexp_replace(text, '^{_SPACE_SQL}+|{_SPACE_SQL}+$', '', 'g'), '{_SPACE_SQL}+') AS w FROM {_generated_sql(SCRIPT_SIGNS, 16)}), "
    "u AS (SELECT id, unnest(w) AS p, generate_subscripts(w, 1) AS k FROM w), n AS (SELECT id, k, p, lead(p) OVER (PARTITION BY id ORDER BY k) AS q FROM u), "
    f"s AS (SELECT id, k, p, q, {_SCRIPT('right(p, 1)')} AS a, {_SCRIPT('left(q, 1)')} AS b FROM n) "
    "SELECT id, string_agg(p || CASE WHEN q IS NULL OR (a <> 'other' AND b <> 'other' AND (a <> b OR a IN ('han', 'kana'))) THEN '' ELSE chr(1) END, '' ORDER BY k) AS norm FROM s GROUP BY id",
    "lang_profile": f"WITH t AS (SELECT CAST(doc_id AS BIGINT) AS id, 'documents' AS origin, text FROM documents UNION ALL SELECT id, 'generated', text FROM {_generated_sql(SCRIPT_SIGNS, 16)}), h AS (SELECT id, origin, substring(text, 1, 2000) AS head FROM t) "
    f"SELECT id, origin, CASE WHEN {_ALL} = 0 THEN 'default' WHEN {_IS('kana')} THEN 'ja' WHEN {_IS('hangul')} THEN 'ko' WHEN {_IS('thai')} THEN 'th' WHEN {_IS('han')} THEN 'cjk' ELSE 'default' END AS profile FROM h",
    "locale_profile": "WITH l AS (SELECT c_custkey, [" + ", ".join(_q(x) for x in LOCALES) + f"][c_custkey % {len(LOCALES)} + 1] || CASE WHEN c_nationkey % 3 = 0 THEN '-N' || c_nationkey ELSE '' END AS locale FROM customer), "
    "b AS (SELECT *, split_part(lower(locale), '-', 1) AS base FROM l) SELECT c_custkey, locale, CASE base WHEN 'zh' THEN 'cjk' WHEN 'ja' THEN 'ja' WHEN 'ko' THEN 'ko' WHEN 'th' THEN 'th' ELSE 'default' END AS profile, "
    "CASE base WHEN 'zh' THEN 'char' ELSE 'word' END AS granularity, CASE WHEN base IN ('zh', 'ja', 'ko', 'th', 'en') THEN base ELSE locale END AS segmenter FROM b",
    "norm_numerals": f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, 'x' || {_UNITS} || 'y' || CAST({_D(3)} AS VARCHAR) || {_UNITS} || 'z' || o_orderkey || chr(1) || '-' || {_D(5)} || '.' || {_D(0)} || {_D(7)} || 'w' AS norm FROM orders",
    "grouped_digits": f"SELECT o_orderkey, CASE WHEN contains({_PRICE}, ',') THEN split_part({_PRICE}, '.', 1) ELSE '' END AS grouped, '' AS never FROM orders",
    "norm_spans": f"WITH m AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s){_SPACE_SQL}+|.') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM m), "
    "e AS (SELECT doc_id, length(w) AS n, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k) AS hi FROM u), s AS (SELECT doc_id, count(*) AS n, sum(hi - n) AS a, sum(hi) AS b FROM e GROUP BY doc_id) "
    "SELECT d.doc_id, coalesce(s.n, 0) AS n_chars, CAST(coalesce(s.a, 0) AS BIGINT) AS starts, CAST(coalesce(s.b, 0) AS BIGINT) AS ends FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id",
    "snap_span": f"WITH t AS (SELECT CAST(id AS BIGINT) AS id, text FROM {_values()} UNION ALL SELECT -conv_id * 1000 - turn - 1, text FROM conversations), "
    "g AS (SELECT id, k, substring_grapheme(text, k, 1) AS c FROM (SELECT id, text, unnest(range(1, length_grapheme(text) + 1)) AS k FROM t)), "
    "e AS (SELECT id, length(c) AS n, CAST(sum(length(c)) OVER (PARTITION BY id ORDER BY k) AS BIGINT) AS hi FROM g) SELECT id, unnest(range(hi - n, hi)) AS cp, hi - n AS lo, hi FROM e",
    "prepared_index": f"SELECT doc_id, md5(text) AS text_md5, md5({_norm('text')}) AS norm_md5 FROM documents",
    "routed": "WITH p AS (SELECT item_id, text, lead(text, 1, '') OVER (ORDER BY item_id) AS other FROM benchmark), "
    "r AS (SELECT 'self' AS kind_of_pair, item_id, text AS document, text FROM p UNION ALL SELECT 'next', item_id, other, text FROM p UNION ALL SELECT 'late', item_id, 'And so. ' || text, text FROM p) "
    "SELECT CASE WHEN contains(document, text) THEN 'hits' ELSE 'misses' END AS sink, kind_of_pair, item_id, strpos(document, text) - 1 AS index, CASE WHEN contains(document, text) THEN 1 ELSE -1 END AS line FROM r",
    "punct_folded": "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'none' WHEN contains(text, '.') THEN 'normalized' ELSE 'exact' END AS kind, coalesce(contains(text, '.'), false) AS punct_folded FROM documents",
    "negation_places": f"SELECT doc_id, {_negations_sql('text')} AS marks FROM documents",
}
