"""Scalar functions, rules and approximate matching against plain statements of what they do."""

import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quotelens.functions import approx, markdown, negation, numerals, particles, scalars
from quotelens.functions.rules import HOLD, normalized, rules, to_column, trace
from quotelens.options import NO_MATCH, Raw, is_hit, with_keep, with_preset

TRICKY = st.text(alphabet="aZ1 \t­​﻿ﬁ①Ｘ，、中文é👍한글カ,.!_-ß", max_size=24)


@settings(max_examples=150, deadline=None)
@given(TRICKY, st.booleans(), st.booleans(), st.booleans())
def test_trace_keeps_order_and_bounds(text, width, punctuation, camel):
    o = with_preset(ignore_width=width, ignore_punctuation=punctuation, split_camel_case=camel)
    t = trace(text, rules(o))
    assert len(t.text) == len(t.start) == len(t.end)
    assert (np.diff(t.start) >= 0).all() and (t.end >= t.start).all()
    assert not len(t.text) or (t.start.min() >= 0 and t.end.max() <= len(text))


@settings(max_examples=100, deadline=None)
@given(TRICKY)
def test_normalisation_is_idempotent(text):
    o = with_preset()
    assert normalized(normalized(text, o), o) == normalized(text, o)


def test_both_evaluators_agree(spark):
    random.seed(5)
    alphabet = "aZ1 \t­​ﬁ①Ｘ，、中文é👍한글カ,.!_-xY23"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randrange(0, 40))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for o in (with_preset(), with_preset("loose"), with_preset(ignore_punctuation="drop", split_camel_case=True)):
        got = [r[0] for r in df.select(to_column(F.col("t"), rules(o))).collect()]
        assert got == [normalized(t, o) for t in texts]


@pytest.mark.parametrize(
    ("text", "want"),
    [("1,234,567", "1234567"), ("1,23", "1,23"), ("中文 AI 中 文", "中文ai中文"), ("한 국", f"한{HOLD}국"), ("ＡＢＣ", "abc"), ("  a  b ", f"a{HOLD}b"), ("1 000", f"1{HOLD}000"), ("，。", ",.")],
)
def test_rules(text, want):
    assert normalized(text, with_preset()) == want


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ("left, right", {"ignore_punctuation": "drop", "punctuation_keep": (Raw(r"\s+"),)}, "left right"),
        ("东……西", {"ignore_punctuation": True, "punctuation_keep": ("……",)}, "东......西"),
        ("东……西", {"ignore_punctuation": True}, "东西"),
        ("东……西", {"ignore_punctuation": True, "punctuation_keep": (Raw(r"\.{2,}"),)}, "东......西"),
        ("东……西", {"ignore_punctuation": True, "punctuation_keep": (Raw("…+"),)}, "东西"),
        ("a+b-c", {"ignore_punctuation": "drop", "punctuation_extra": ("+",)}, "abc"),
        ("a+b-c", {"ignore_punctuation": "drop"}, "a+bc"),
        ("x--y (z)", {"ignore_punctuation": "drop", "punctuation_keep": ("--", "(")}, "x--y(z"),
    ],
)
def test_kept_punctuation(spark, text, options, want):
    o = with_preset(**options)
    assert normalized(text, o) == want
    assert spark.createDataFrame([(text,)], "t string").select(to_column(F.col("t"), rules(o))).first()[0] == want


def test_what_is_kept_can_be_added_to():
    o = with_preset(ignore_punctuation=True, punctuation_keep=("--",))
    assert with_keep(o, Raw("x+")).punctuation_keep == ("--", Raw("x+"))
    off = with_preset(ignore_punctuation=True, preserve_ellipsis=False)
    assert with_keep(off, "a") == off and with_keep(with_preset(), "a") == with_preset()
    with pytest.raises(ValueError):
        rules(with_preset(ignore_punctuation=True, punctuation_keep=(Raw("x*"),)))


def test_presets():
    assert with_preset("loose", min_segment_length=9).min_segment_length == 9
    assert with_preset("strict").max_cross_blocks == 1 and not with_preset("strict").ellipsis
    with pytest.raises(ValueError):
        with_preset("none such")
    with pytest.raises(TypeError):
        with_preset(no_option=1)
    assert not is_hit(NO_MATCH)


@pytest.mark.parametrize(("text", "n"), [("列车没在站台停留", 1), ("我们不得不等", 2), ("非常高兴", 0), ("他未来会来", 0), ("don't know", 1), ("a notice of none", 1), ("无限量的纸张", 0)])
def test_negation(spark, text, n):
    assert len(negation.detect_negation(text)) == n
    assert spark.createDataFrame([(text,)], "t string").select(negation.negation_count(F.col("t"))).first()[0] == n


def test_negation_lexicon():
    assert len(negation.detect_negation("他未来", negations=["未来"])) == 1
    assert not negation.detect_negation("没有", non_negations=["没有"])
    assert not negation.conflicting_words()


def test_particles(spark):
    tagger = particles.guard_list_tagger()
    assert tagger("宽广的大地") == {2} and tagger("慢慢地走") == {2} and tagger("值得") == set()
    rows = spark.createDataFrame([("慢慢地走在大地",)], "t string").select(particles.fold_particles(F.col("t"))).first()
    assert rows[0] == "慢慢的走在大地"
    assert particles.word_tagger(lambda t: [("慢", "d"), ("地", "uv")])("慢地") == {1}


@pytest.mark.parametrize(("text", "value"), [("一兆", 10**12), ("三萬", 30000), ("三点五", "3.5"), ("负三", -3), ("負二十點零一", "-20.01"), ("点", None), ("三点", None), ("负", None), ("十", 10), ("二十三", 23), ("一百零五", 105), ("一千二百三十四", 1234), ("三万五千", 35000), ("一亿", 10**8), ("二〇二四", 2024), ("百千", None)])
def test_numerals(text, value):
    assert numerals.parse_numeral(text) == value


def test_scalars(spark):
    df = spark.createDataFrame([("parseHTTPResponse_v2-final ab",)], "t string")
    r = df.select(scalars.split_camel_case(F.col("t")), scalars.normalize_separators(F.col("t")), scalars.identifier_breaks(F.col("t")), scalars.graphemes(F.lit("👍🏽a")), scalars.occurrences(F.lit("aaaa"), F.lit("aa"))).first()
    assert r[0] == "parse HTTPResponse_v2-final ab" and r[1] == "parseHTTPResponse v2 final ab"
    assert [(b["at"], b["kind"]) for b in r[2]] == [(5, "insert"), (17, "replace"), (20, "replace")]
    assert r[3] == 2 and r[4] == 3
    assert scalars.profile_for("zh-TW")[0] == "cjk" and scalars.profile_for("xx")[3] == "xx"
    assert regex.fullmatch(scalars.grouped_digits_pattern(",_"), "1,234_567") and not regex.match(scalars.grouped_digits_pattern(""), "1,234")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdef ", min_size=8, max_size=50), st.integers(0, 6), st.randoms(use_true_random=False))
def test_approximate_matches_are_disjoint_and_scored(content, noise, rnd):
    hay = " xyz ".join([content] * 3)
    needle = list(content)
    for _ in range(noise):
        needle.insert(rnd.randrange(len(needle)), "#")
    found = approx.find("".join(needle), hay, most=3)
    assert all(0 <= c.start < c.end <= len(hay) and 0 < c.score <= 1 for c in found)
    assert [c.score for c in found] == sorted((c.score for c in found), reverse=True)
    assert all(a.end <= b.start or b.end <= a.start for i, a in enumerate(found) for b in found[i + 1 :])


def test_approximate_span():
    hay = "nothing here; the quick brown fox jumps over the lazy dog"
    c = approx.find("quick brwn fx jumps", hay)[0]
    assert hay[c.start : c.end] == "quick brown fox jumps" and c.score > 0.9
    assert approx.find("a", hay) == [] and approx.pick_seed(hay, "abc") is None


MD = "---\nx: 1\n---\n# Head\n\nSome **bold _in_ text** &amp; [link](u) `code` ![i](u).\n\n> quote\n\n| a | b |\n|---|---|\n| c | d |\n\n<!-- c -->\n\n```\nx = 1\n```\n"


def test_markdown():
    f = markdown.flatten(MD)
    assert f.text == "Head\nSome bold in text & link code .\nquote\nabcd\nx = 1\n"
    assert len(f.blocks) == 5 and all(f.text[a:b] for a, b, *_ in f.blocks)
    j = markdown.joined(f)
    assert "\n" not in j.text and j.blocks[-1][1] == len(j.text)
    at = f.text.index("bold")
    assert MD[slice(*markdown.expand_to_markers(f, at, f.text.index(" text") + 4, *f.trace.span(at, f.text.index(" text") + 5)))] == "**bold _in_ text**"
    assert markdown.regex_flatten("# A **b** [c](d)\n&lt;").text == "A b c\n<"
    assert markdown.trim_edges("**a**", 0, 5) == (2, 1) and markdown.joined(markdown.identity_flat("ab")) is None


def test_capabilities():
    from quotelens.capabilities import assembled, capabilities, capability, register_capability

    assert capabilities()["fuzzy"] and capability("fuzzy") is capability("fuzzy")
    register_capability("absent", "no_such_module", "thing")
    assert capability("absent") is None and not capabilities()["absent"]
    assert assembled().fallbacks == ("bitap",) and assembled().markdown == "commonmark"
    assert assembled("strict").fallbacks == () and assembled(markdown=None).markdown is None
    assert assembled(cjk_numerals=True).cjk_numeral_parser("十二", 0) == (12, 2)


def test_word_segmenter():
    from quotelens.functions.segmenters import word_segmenter

    assert word_segmenter("zh-CN")("短句") == [(0, "短"), (1, "句")]
    assert word_segmenter("fr")("un chat") == [(0, "un"), (3, "chat")]
    assert word_segmenter("en") is word_segmenter("not a locale!") and word_segmenter("FR") is word_segmenter("fr")


def test_cached_flattener():
    from quotelens.functions.markdown import CachedFlattener, flatten

    calls = []
    cached = CachedFlattener(lambda s: calls.append(s) or flatten(s), most=2)
    assert cached("*a*").text == cached.flatten("*a*").text == flatten("*a*").text and calls == ["*a*"]
    assert cached.flatten_by_id("d", "b") is cached.flatten_by_id("d", "other") and len(cached) == 2
    cached("c")
    cached("*a*")
    assert calls == ["*a*", "b", "c", "*a*"]
    cached.clear()
    assert len(cached) == 0
