"""Negation marks and polarity. The parity of the marks decides, so a double negation is none."""

from __future__ import annotations

from collections.abc import Iterable

import regex

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import WORD_TOKEN, tokens

# Word lists.
CHINESE_NEGATION_WORDS = frozenset("没有 不是 不能 不会 不要 不必 不该 未能 尚未 并非 从未 未曾 并不 绝不 无法 无需 未必 不 没 无 未 非 别 莫 勿 否 休".split())
CHINESE_NON_NEGATION_WORDS = frozenset("非常 别人 别的 非法 除非 非洲 是非 非议 无锡 无意 无关 无论 无穷 无限 无奈 无耻 未来 未免 特别 区别 分别 类别 级别 差别 告别 送别 休息 退休 否定 否则 是否".split())
ENGLISH_NEGATION_WORDS = frozenset("not never neither nor without cannot hardly nowhere nothing no none nobody won't".split())
ENGLISH_NEGATION_SUFFIX = "n't"
LONGEST = 4


def merge_lexicon(negations: Iterable[str] = (), non_negations: Iterable[str] = ()) -> tuple[set[str], set[str]]:
    """The word lists with additions: a new negation loses its protection, and non-negations win over all."""
    yes, no = set(CHINESE_NEGATION_WORDS) | set(negations), set(CHINESE_NON_NEGATION_WORDS) - set(negations)
    return yes - set(non_negations), no | set(non_negations)


def conflicting_words() -> set[str]:
    return set(CHINESE_NEGATION_WORDS & CHINESE_NON_NEGATION_WORDS)


def chinese_pattern(negations: Iterable[str] = (), non_negations: Iterable[str] = ()) -> str:
    """Protected words first, then negations (group 1), each longest first: one scan from the left, as alternatives."""
    yes, no = merge_lexicon(negations, non_negations)
    order = lambda words: "|".join(sorted((regex.escape(w) for w in words if w and len(w) <= LONGEST), key=lambda w: (-len(w), w)))
    return f"(?:{order(no)})|({order(yes)})"


def negation_count(text: Column, negations: Iterable[str] = (), non_negations: Iterable[str] = ()) -> Column:
    """Number of negation marks."""
    chinese = F.filter(F.regexp_extract_all(text, F.lit(chinese_pattern(negations, non_negations)), F.lit(1)), lambda w: w != "")
    known = F.array(*[F.lit(w) for w in sorted(ENGLISH_NEGATION_WORDS)])
    english = F.filter(tokens(text, "word"), lambda w: w.rlike("^[A-Za-z]") & (F.array_contains(known, F.lower(w)) | F.lower(w).endswith(ENGLISH_NEGATION_SUFFIX)))
    return F.size(chinese) + F.size(english)


def negated(text: Column, negations: Iterable[str] = (), non_negations: Iterable[str] = ()) -> Column:
    return F.pmod(negation_count(text, negations, non_negations), F.lit(2)) == 1


def negations_conflict(a: Column, b: Column, negations: Iterable[str] = (), non_negations: Iterable[str] = ()) -> Column:
    """Whether two texts are of opposite polarity."""
    return negated(a, negations, non_negations) != negated(b, negations, non_negations)


_TOKENS = regex.compile(WORD_TOKEN)


def detect_negation(text: str, negations: Iterable[str] = (), non_negations: Iterable[str] = ()) -> list[tuple[int, str]]:
    """Places and words of the negation marks of one string, for hit rows."""
    marks = [(m.start(), m.group()) for m in _TOKENS.finditer(text) if regex.match("[A-Za-z]", m.group()) and ((w := m.group().lower()) in ENGLISH_NEGATION_WORDS or w.endswith(ENGLISH_NEGATION_SUFFIX))]
    marks += [(m.start(1), m.group(1)) for m in regex.finditer(chinese_pattern(negations, non_negations), text) if m.group(1)]
    return sorted(marks)
