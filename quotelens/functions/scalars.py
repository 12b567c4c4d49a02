"""Scalar functions on text columns: scripts, language, tokens, graphemes, places, counts, numbers and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import DASHES, HOLD, SCRIPTS, SPACE, SPACE_ROLE, camel_rule, grouping_rule, separators_rule, to_column

#: Language profiles (id, drops spaces between CJK, granularity, segmenter locale), and their locales.
PROFILES = {
    "cjk": ("cjk", True, "char", "zh"),
    "ja": ("ja", True, "word", "ja"),
    "ko": ("ko", True, "word", "ko"),
    "th": ("th", True, "word", "th"),
    "default": ("default", True, "word", "en"),
}
LOCALES = {"zh": "cjk", "zh-cn": "cjk", "zh-tw": "cjk", "zh-hant": "cjk", "ja": "ja", "ko": "ko", "th": "th", "en": "default"}
SAMPLE = 2000
MINORITY = 0.15
_CJK = SCRIPTS["han"] + SCRIPTS["kana"]
_LETTER = f"(?![{_CJK}])[\\p{{L}}\\p{{N}}\\p{{M}}_]"
#: A word token: one sign of Han or kana, or a run of letters and digits, apostrophes and points inside it included.
WORD_TOKEN = f"[{_CJK}]|(?:{_LETTER})+(?:['\u2019.](?:{_LETTER})+)*"


def script_of(char: Column) -> Column:
    """han, kana, thai, hangul, latin, digit or other, of a one-character string."""
    out = F.lit("other")
    for name, chars in reversed(SCRIPTS.items()):
        out = F.when(char.rlike(f"^[{chars}]"), name).otherwise(out)
    return out


def can_drop_space_between(left: Column, right: Column) -> Column:
    """Whether a space between characters of these scripts carries no meaning."""
    ignorable = [s for s, role in SPACE_ROLE.items() if role == "ignorable"]
    return (left != "other") & (right != "other") & ((left != right) | left.isin(ignorable))


def script_counts(text: Column) -> dict[str, Column]:
    sample = F.substring(text, 1, SAMPLE)
    return {s: F.regexp_count(sample, F.lit(f"[{SCRIPTS[s]}]")) for s in ("han", "kana", "hangul", "thai", "latin")}


def language_profile(text: Column) -> Column:
    """The profile id of a text, by the shares of its minority scripts in a fixed order."""
    n = script_counts(text)
    total = reduce(lambda a, b: a + b, n.values())
    out = F.lit("default")
    for script, profile in (("han", "cjk"), ("thai", "th"), ("hangul", "ko"), ("kana", "ja")):
        out = F.when(n[script] / total >= MINORITY, profile).otherwise(out)
    return F.when(total == 0, "default").otherwise(out)


def profile_for(locale: str) -> tuple[str, bool, str, str]:
    """The profile of a locale name: the name itself, its base language, or the default with this locale."""
    key = locale.lower()
    for k in (key, key.split("-")[0]):
        if k in LOCALES:
            return PROFILES[LOCALES[k]]
    return ("default", True, "word", locale or "en")


def profile_of_locale(locale: Column) -> Column:
    """``profile_for`` of a column, as a struct of id, granularity and locale."""
    row = lambda p, name: F.struct(F.lit(p[0]).alias("id"), F.lit(p[2]).alias("granularity"), name.alias("locale"))
    low = F.lower(locale)
    base = F.substring_index(low, "-", 1)
    out = row(PROFILES["default"], F.when(locale == "", "en").otherwise(locale))
    for key in (base, low):
        for name, profile in LOCALES.items():
            out = F.when(key == name, row(PROFILES[profile], F.lit(PROFILES[profile][3]))).otherwise(out)
    return out


def tokens(text: Column, granularity: str) -> Column:
    """Code points, or words; a word of Han or kana alone is taken apart into characters."""
    if granularity == "char":
        return F.filter(F.split(text, ""), lambda c: c != "")
    return F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(0))


def word_count(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda t: t.rlike(r"[\p{L}\p{N}]")))


def graphemes(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0)))


def line_of(text: Column, cp_index: Column) -> Column:
    """1-based line of a 0-based code point offset."""
    return F.regexp_count(F.substring(text, F.lit(1), cp_index.cast("int")), F.lit("\n")) + 1


def utf16_offset(text: Column, cp_index: Column) -> Column:
    """UTF-16 code units before a 0-based code point offset."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), cp_index.cast("int")), "UTF-16BE")) / 2).cast("int")


def occurrences(text: Column, part: Column, cap: int = 50) -> Column:
    """Overlapping occurrences of ``part``, at most ``cap``."""
    after = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)))
    found = F.filter(after, lambda i: F.substring(text, i, F.length(part)) == part)
    return F.when((F.length(part) == 0) | (F.length(text) < F.length(part)), 0).otherwise(F.least(F.size(found), F.lit(cap)))


def strip_grouping(text: Column, underscore: bool = False) -> Column:
    return to_column(text, [grouping_rule(underscore)])


def grouped_digits_pattern(separators: str) -> str:
    """A pattern of digit groups parted by these separators; it never matches if there are none."""
    import regex

    return f"[0-9]+(?:[{regex.escape(separators)}][0-9]{{3}})+(?![0-9])" if separators else "(?!)"


def split_camel_case(text: Column, to: str = " ") -> Column:
    return to_column(text, [camel_rule(to)])


def normalize_separators(text: Column, to: str = " ") -> Column:
    return to_column(text, [separators_rule(to)])


def normalize_identifier(text: Column, to: str = " ") -> Column:
    return split_camel_case(normalize_separators(text, to), to)


def identifier_breaks(text: Column) -> Column:
    """Places and kinds of identifier breaks, as an array of struct at, kind, source_length."""
    inside, dash = "[A-Za-z0-9]", f"[_{DASHES}]"
    at = lambda i: F.substring(text, i, F.lit(1))
    between = lambda i: at(i).rlike(dash) & at(i - 1).rlike(inside) & at(i + 1).rlike(inside)
    kind = lambda i: F.when((i > 1) & between(i), "replace").when((i > 1) & at(i - 1).rlike("[a-z0-9]") & at(i).rlike("[A-Z]"), "insert")
    spots = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda i: F.struct((i - 1).alias("at"), kind(i).alias("kind"), F.when(kind(i) == "replace", 1).otherwise(0).alias("source_length")))
    return F.filter(spots, lambda s: s["kind"].isNotNull())


def anchor_too_weak(anchor: Column, least: int) -> Column:
    """Whether a normalised anchor is too short, and too few words, to stand for a place."""
    words = F.size(F.filter(F.split(anchor, HOLD), lambda s: s.rlike(r"[\p{L}\p{N}]")))
    short = F.length(F.regexp_replace(anchor, HOLD, "")) < least
    return short & (~F.contains(anchor, F.lit(HOLD)) | (words < 2))


def clamp01(x: Column) -> Column:
    finite = ~(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)


def trim_markdown_edges(text: Column) -> Column:
    return F.regexp_replace(text, r"^[*_`~#>|\-\\" + SPACE + r"]+|[*_`~#>|\-\\" + SPACE + r"]+$", "")
