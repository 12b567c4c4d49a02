"""The ladder on single pairs, and the corpus operators against it."""

import random
import time

import pytest
import regex

from pyspark.sql import functions as F

from quotelens.functions.negation import detect_negation
from quotelens.operators import locate, semantic
from quotelens.operators.pairs import Matcher, snap, snapped
from quotelens.options import with_preset
from quotelens.sources import hits, misses, prepare, read_documents
from quotelens.streaming import route, stream_documents, stream_pairs

DOC = "The Quick brown fox, worth 1,234 coins, jumps over the lazy dog. Then it sleeps for a long time in the sun."
PAGE = "# Title\n\nSome **bold text** here.\n\nNext *para* &amp; more.\n"


@pytest.mark.parametrize(
    ("excerpt", "text", "options", "kind", "span"),
    [
        ("brown fox", DOC, {}, "exact", "brown fox"),
        ("QUICK  brown FOX, worth 1234", DOC, {}, "normalized", "Quick brown fox, worth 1,234"),
        ("Quick brown〔略〕lazy dog", DOC, {}, "segmented", "Quick brown fox, worth 1,234 coins, jumps over the lazy dog"),
        ("Quick brown〔略〕lazy dog", DOC, {"max_gap": 5}, "none", ""),
        ("Quick brown〔略〕lazy dog", DOC, {"ellipsis": False}, "none", ""),
        ("The Quick brown fox. Then it sleeps", DOC, {"implicit_ellipsis": True}, "segmented", DOC[:80]),
        ("brown fx, worth 1,234 coins jumps", DOC, {"fallbacks": ("bitap",)}, "fuzzy", "brown fox, worth 1,234 coins, jumps"),
        ("nothing of the kind at all", DOC, {"fallbacks": ("bitap",)}, "none", ""),
        ("中文 AI", "a中文AI 中 文b", {}, "normalized", "中文AI"),
        ("三十四", "他有34个", {"cjk_numerals": True}, "normalized", "34"),
        ("慢慢的走", "他慢慢地走", {"ignore_particles": True}, "normalized", "慢慢地走"),
        ("bold text", PAGE, {"markdown": "commonmark"}, "exact", "**bold text**"),
        ("bold text", PAGE, {"markdown": "commonmark", "trim_markdown_edges": True}, "exact", "bold text"),
        ("here.Next", PAGE, {"markdown": "commonmark"}, "exact", "here.\n\nNext"),
        ("here.Next", PAGE, {"preset": "strict", "markdown": "commonmark"}, "none", ""),
        ("**bold text** here", PAGE, {"markdown": "commonmark", "excerpt_is_markdown": True}, "normalized", "**bold text** here"),
        ("does not jump over", "He does jump over the wall", {"fallbacks": ("bitap",), "min_fallback_score": 0.5}, "none", ""),
        ("👍", "a👍🏽b", {}, "exact", "👍🏽"),
        ("", DOC, {}, "none", ""),
        ("x", None, {}, "none", ""),
    ],
)
def test_ladder(excerpt, text, options, kind, span):
    m = Matcher(with_preset(**options)).match(excerpt, text)
    assert m["kind"] == kind
    if kind == "none":
        assert (m["index"], m["length"], m["score"], m["occurrences"]) == (-1, 0, 0.0, 0)
    else:
        assert text[m["cp_index"] : m["cp_index"] + m["cp_length"]] == span and 0 < m["score"] <= 1


def test_coordinates_are_utf16():
    m = Matcher().match("b😀", "a😀b😀")
    assert (m["index"], m["length"], m["cp_index"], m["cp_length"]) == (3, 3, 2, 2)


def test_punctuation_difference_is_told():
    o = with_preset(ignore_punctuation=True)
    assert Matcher(o).match("one two", "say one; two now")["kind"] in ("none", "normalized")
    assert Matcher(with_preset(ignore_punctuation="drop")).match("one two", "say one; two now")["punct_folded"]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(1, DOC), (2, "nothing"), (3, None), (4, DOC + " " + DOC), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "lazy dog"), (11, "quick BROWN"), (12, ""), (13, None), (14, "no such thing")], "item_id long, text string")
    return docs, items


def test_exact_pairs(corpus):
    docs, items = corpus
    got = {tuple(r) for r in locate.exact_pairs(docs, items).collect()}
    assert got == {(1, 10, DOC.index("lazy"), 1), (4, 10, DOC.index("lazy"), 2)}
    assert {tuple(r) for r in locate.exact_pairs_native(docs, items).collect()} == got
    assert locate.exact_pairs(docs.limit(0), items).count() == 0 and locate.exact_pairs(docs, items.limit(0)).count() == 0


def test_locate_finds_what_pairs_find(corpus):
    docs, items = corpus
    o = with_preset(fallbacks=("bitap",))
    found = {(r["doc_id"], r["item_id"]): r["kind"] for r in locate.locate(docs, items, o).collect()}
    pairs = docs.withColumnRenamed("text", "document").crossJoin(items.withColumnRenamed("text", "excerpt"))
    every = locate.match_pairs(pairs, o)
    assert every.count() == 25
    assert {(r["doc_id"], r["item_id"]): r["kind"] for r in hits(every).collect()} == found
    assert misses(every).count() == 25 - len(found)
    filled = locate.with_misses(pairs, locate.locate(docs, items, o), ["doc_id", "item_id"])
    assert filled.where("kind = 'none'").count() == 25 - len(found)
    units = every.join(docs.select("doc_id", F.length("text").alias("n_units")), "doc_id")
    assert locate.check_invariants(units).count() == 0


@pytest.mark.parametrize(
    "options",
    [{"fallbacks": ("bitap",)}, {"preset": "loose", "fallbacks": ("bitap",)}, {"implicit_ellipsis": True}, {"max_gap": 30}, {"ignore_punctuation": True}, {"markdown": "commonmark", "excerpt_is_markdown": True}, {"preset": "strict", "markdown": "commonmark"}, {"markdown": "regex", "fallbacks": ("bitap",)}],
)
def test_locate_is_match_pairs_over_all_pairs(spark, options):
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    sentence = lambda: " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(6, 14))).capitalize() + "."
    docs = [(i, "\n\n".join(" ".join((sentence(), sentence(), "**" + sentence() + "**" if rnd.random() < 0.3 else sentence())) for _ in range(3))) for i in range(14)] + [(None, None), (99, "")]
    items = []
    for d, text in docs[:14]:
        flat = text.replace("**", "")
        a = rnd.randrange(len(flat) - 150)
        part = flat[a : a + 110]
        edit = lambda step, part=part: "".join(("#" if k % (2 * step) == 0 else "") if k % step == 0 else c for k, c in enumerate(part))
        items += [part, part.upper(), edit(10), edit(12), part[:12][:5] + part[:12][6:], part[:40] + "..." + part[70:], text[a : a + 60], ". ".join(flat.split(". ")[:: 2])[:150]]
    items += [None, "", "zz"]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    o = with_preset(**options)
    pairs = left.withColumnRenamed("text", "document").crossJoin(right.withColumnRenamed("text", "excerpt"))
    key = lambda r: (r["doc_id"], r["item_id"], r["kind"], r["cp_index"], r["cp_length"])
    every = {key(r): r["score"] for r in hits(locate.match_pairs(pairs, o)).collect()}
    found = {key(r) for r in locate.locate(left, right, o).collect()}
    assert found <= set(every)
    # Fuzzy hits that are more than one edit in six away, such as chance likenesses of short excerpts, may be left out.
    assert all(k[2] == "fuzzy" and s < 0.9 for k, s in every.items() if k not in found)
    if o.fallbacks:
        assert {key(r) for r in locate.locate(left, right, o, exhaustive=True).collect()} == set(every)
        assert all(any(k[0] == d and k[1] == 8 * d + n for k in found) for d in range(14) for n in (2, 3))


def test_null_and_repeated_ids_are_kept_apart(spark):
    docs = spark.createDataFrame([(None, DOC), (None, "b " + DOC), (7, "lazy dog"), (7, "the lazy dog")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "lazy dog"), (1, "lazy"), (None, "lazy dog")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["cp_index"], r["cp_length"]) for r in locate.exact_matches(docs, items).collect())
    assert len(got) == 12 and got == sorted((i, j, at, n) for i, at in ((0, DOC.index("lazy")), (0, DOC.index("lazy") + 2), (7, 0), (7, 4)) for j, n in ((1, 8), (1, 4), (0, 8)))


@pytest.mark.parametrize("polarity", [True, False])
def test_recall_over_the_corpus_by_definition(spark, polarity):
    rnd = random.Random(13)
    docs = [(i, " ".join(rnd.choice(["red", "green", "not", "never", "zebra", "x.", "quick!", "a\n"]) for _ in range(rnd.randrange(1, 40)))) for i in range(40)] + [(None, None), (50, "")]
    items = [(1, "red zebra quick"), (2, "not green"), (3, "qqq"), (4, None), (5, "xyz abc red")]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, excerpt string")
    parts = [(r["doc_id"], r["seg_index"], r["segment"]) for r in semantic.split_segments(left).collect()]
    odd = lambda t: len(detect_negation(t)) % 2
    want = set()
    for i, e in items:
        scored = [(-sum(c in s for c in e) / len(e), d, k) for d, k, s in parts if not polarity or odd(s) == odd(e)] if e else []
        want |= {(i, d, k, n) for n, (s, d, k) in enumerate(sorted(x for x in scored if x[0] <= -0.5)[:3])}
    got = {(r["item_id"], r["doc_id"], r["seg_index"], r["recall_rank"]) for r in semantic.recall_corpus(left, right, check_polarity=polarity).collect()}
    assert got == want and len(got) >= 6


def test_recall_is_the_last_tier(spark):
    docs = spark.createDataFrame([(1, DOC), (2, "Rain fell on the quiet harbour all night.")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "lazy dog"), (2, "Rain fell on quiet harbour night")], "item_id long, text string")
    got = {r["item_id"]: (r["doc_id"], r["kind"]) for r in semantic.locate_or_recall(docs, items).collect()}
    assert got == {1: (1, "exact"), 2: (2, "semantic")}


@pytest.mark.parametrize("options", [{}, {"markdown": "commonmark"}])
def test_recalled_segments_keep_their_coordinates(spark, options):
    body = "Storm  clouds　gathered   ... over 1,234,567 roofs.\n\n**Somebody** in the  long  street saw the grey heron land. "
    docs = spark.createDataFrame([(1, body * 3), (2, "Quiet."), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "in long street the grey heron land")], "item_id long, text string")
    row = semantic.locate_or_recall(docs, items, with_preset(**options)).collect()
    assert len(row) == 1 and row[0]["kind"] == "semantic" and "grey heron land" in row[0]["source"] and len(row[0]["source"]) < 80


def test_markers_of_the_innermost_construct():
    o = with_preset(markdown="commonmark")
    text = "See **[link text](http://u)** now, *a **b** c*."
    span = lambda e: text[(m := Matcher(o).match(e, text))["cp_index"] : m["cp_index"] + m["cp_length"]]
    assert span("link text") == "[link text](http://u)" and span("b") == "**b**" and span("a b") == "*a **b**"


def test_segments_and_recall(spark):
    docs = spark.createDataFrame([(1, "One two three. Four five!\n\n" + "x" * 650), (2, None)], "doc_id long, text string")
    rows = semantic.split_segments(docs).orderBy("start").collect()
    text = docs.first()["text"]
    assert [text[r["start"] : r["start"] + len(r["segment"])] == r["segment"] for r in rows] == [True] * 5
    excerpts = spark.createDataFrame([(1, 7, "four fiv")], "doc_id long, item_id long, excerpt string")
    top = semantic.recall(semantic.split_segments(docs), excerpts, top_k=2, least=0.1)
    assert [r["recall_rank"] for r in top.orderBy("recall_rank").collect()] == [0, 1]
    hit = semantic.semantic_matches(docs, top).first()
    assert hit["kind"] == "semantic" and "our fiv" in hit["source"]
    assert semantic.segment_fallback(top).first()["score"] == pytest.approx(0.9)


def test_sources_and_streams(spark, corpus, tmp_path):
    docs, items = corpus
    assert prepare(docs.union(docs)).count() == 5
    (tmp_path / "a.txt").write_text("some words")
    assert read_documents(spark, str(tmp_path), "text").first()["text"] == "some words"
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, 10, "lazy dog"), (2, 11, "absent")], "doc_id long, item_id long, excerpt string").write.parquet(path)
    stream = spark.readStream.schema("doc_id long, item_id long, excerpt string").parquet(path)
    seen = {"hit": [], "miss": []}
    q = route(stream_pairs(stream, docs), lambda d: seen["hit"].extend(d.collect()), lambda d: seen["miss"].extend(d.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert len(seen["hit"]) == 1 and len(seen["miss"]) == 1
    docs.write.parquet(str(tmp_path / "docs"))
    found = stream_documents(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "docs")), items)
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck2")).start() if found.isStreaming else None
    if q:
        q.processAllAvailable()
        q.stop()
        assert spark.table("found").count() == 2


def test_snap_walks_once_and_to_the_ends_of_long_clusters():
    texts = ["", "ab\r\nc", "中文é́ 한국어", "ab \r\n؀a👍🏽ทดสอบ", "x" + "🇫🇷" * 90 + "🇩🇪🇫", "ae" + "\u0301" * 150 + "b", "क्षि" * 40]
    for t in texts:
        ends = [m.end() for m in regex.finditer(r"\X", t)]
        whole = [(lo, hi) for lo, hi in zip([0, *ends], ends) for _ in range(lo, hi)]
        lo, hi = snapped(t)
        assert list(zip(lo.tolist(), hi.tolist())) == whole == [snap(t, k, k + 1) for k in range(len(t))]
        assert all(snap(t, a, b) == (whole[a][0], whole[b - 1][1]) for a in range(0, len(t), 7) for b in range(a + 1, len(t) + 1, 5))
    assert snap("abc", -5, 99) == (0, 3) and snap("e\u0301", 1, 1) == (1, 1)


def test_snap_span_takes_a_worker_no_longer_than_its_text(spark, tmp_path):
    """Batches are of bounded size, and no code point is looked at again for its neighbours."""
    from quotelens.plans.strings import SPAN_ROWS, snap_span

    rows = [(i, 0, "e\u0301 " * 50_000 if i % 2 else "plain " * 25_000) for i in range(8)] + [(8, 0, None), (9, 0, ""), (None, 1, "a\r\n")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.time()
    got = snap_span(spark, str(tmp_path)).where("id is null or id <= 0")
    assert got.count() == 8 * 150_000 + 3 and time.time() - began < 30
    assert sorted(tuple(r) for r in got.where("id is null").collect()) == [(None, 0, 0, 1), (None, 1, 1, 3), (None, 2, 1, 3)]
    assert got.where("id = -1001").groupBy().agg(F.sum(F.col("hi") - F.col("lo"))).first()[0] == 50_000 * 5 and SPAN_ROWS < 1_200_000


@pytest.fixture
def counted(monkeypatch):
    """Texts that are flattened and normalised, in order."""
    from quotelens.operators import pairs

    seen = {"flat": [], "norm": []}
    pairs.prepared.cache_clear()
    pairs._needle.cache_clear()
    flatten, normalize = pairs.flatten, pairs.normalize
    monkeypatch.setitem(pairs._FLATTENED, "commonmark", lambda t: seen["flat"].append(t) or flatten(t))
    monkeypatch.setattr(pairs, "normalize", lambda t, o: seen["norm"].append(t) or normalize(t, o))
    return seen


def test_options_of_the_result_share_a_prepared_document(counted):
    """Limits of blocks, signs at edges and fallbacks come after preparation: one flattening, one normalisation a view and excerpt."""
    md = f"# First line {random.random()}\n\n**Second** line\n\n- third"
    options = [{"max_cross_blocks": float("inf")}, {"max_cross_blocks": 2}, {"expand_markers": False}, {"trim_markdown_edges": True}, {"max_gap": 7}]
    kinds = [Matcher(with_preset(markdown="commonmark", **o)).match("Second line third", md)["kind"] for o in options]
    assert kinds == ["normalized"] * 5 and len(counted["flat"]) == 1 and len(counted["norm"]) == 3
    assert Matcher(with_preset(markdown="commonmark", max_cross_blocks=1)).match("Second line third", md)["kind"] == "none" and len(counted["norm"]) == 3
    assert Matcher(with_preset(markdown="commonmark", ignore_case=False)).match("second line third", md)["kind"] == "none" and len(counted["flat"]) == 2 and len(counted["norm"]) == 6


def test_match_pairs_by_is_match_pairs_for_each(spark):
    rows = [(1, PAGE, "bold text"), (2, PAGE, "here. Next"), (None, PAGE, "absent"), (2, PAGE, "here.Next"), (3, None, "x"), (4, "**a**", None), (5, "", "")]
    pairs = spark.createDataFrame(rows, "id int, document string, excerpt string")
    options = {"any": with_preset(markdown="commonmark"), "one": with_preset(markdown="commonmark", max_cross_blocks=1), "plain": with_preset()}
    got = [tuple(r) for r in locate.match_pairs_by(pairs, options, "which").collect()]
    want = [(r[0], k, *r[1:]) for k, o in options.items() for r in locate.match_pairs(pairs, o).collect()]
    assert len(got) == 21 and sorted(got, key=repr) == sorted(want, key=repr)


def test_rules_on_points_match_their_patterns():
    from quotelens.functions import rules

    draw = random.Random(4)
    spaces, drop = rules.space_rules()[0], rules.space_rules(False)[0]
    subs = [spaces, drop, rules.Sub(f"[{rules.SPACE}]+", rules.HOLD), rules.Sub(f"[{rules.ZERO_WIDTH}]", ""), rules.grouping_rule(), rules.camel_rule(), rules.Sub("[ab]+", "<>"), rules.Sub("[^a]", "-")]
    for _ in range(400):
        t = "".join(draw.choice(["a", "B", "1", "234", ",", " ", "\n", "中", "あ", "한", "ไ", "😀", "\u200b", *[rules.HOLD] * 4]) for _ in range(draw.randint(0, 14)))
        for rule in subs:
            spans = [m.span() for m in regex.finditer(rule.pattern, t)]
            got = rules.trace(t, [rule])
            assert got.text == regex.sub(rule.pattern, lambda m, to=rule.to: to, t)
            inside = {i for a, b in spans for i in range(a, b)}
            want = sorted([(i, i + 1, 0) for i in range(len(t)) if i not in inside] + [(a, b if b > a else a, -1) for a, b in spans for _ in rule.to], key=lambda x: (x[0], x[2]))
            assert list(zip(got.start.tolist(), got.end.tolist())) == [x[:2] for x in want]


def test_an_exact_hit_normalises_nothing(counted):
    """Modes of the span of a verbatim hit: the document is flattened once, and no view of it is normalised."""
    md = f"# **Bold** {random.random()}\n\n**Second** line"
    spans = [Matcher(with_preset(markdown="commonmark", **o)).match("Bold", md) for o in ({}, {"expand_markers": False}, {"trim_markdown_edges": True})]
    assert [(m["kind"], m["cp_index"], m["cp_length"]) for m in spans] == [("exact", 2, 8), ("exact", 4, 4), ("exact", 4, 4)]
    assert counted["flat"] == [md] and counted["norm"] == []
