"""Normalisation as an ordered list of rewriting rules.

One rule list serves two evaluators: ``to_column`` compiles it to Column expressions (regexp_replace, translate, lower), and
``trace`` applies it in Python while it keeps the source interval of every character. So the corpus is searched natively
and coordinates are recovered for hits only, with the same semantics. Patterns are in the dialect that Java and the
``regex`` module share; white space is always an explicit class.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import regex

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import ELLIPSIS_MARKER, MatchOptions, Raw

#: Stands for white space, and for punctuation that is ignored.
HOLD = "\u0001"
#: Stands for a protected omission marker while punctuation is ignored.
MARK = "\ue000"
#: What counts as white space.
SPACE = "\t\n\u000b\u000c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Zero-width code points that are stripped.
ZERO_WIDTH = "\u00ad\u200b-\u200f\u2060-\u2064\u061c\ufe00-\ufe0f\U000e0100-\U000e01ef"
#: Groups of punctuation signs that fold to their first member.
PUNCTUATION_GROUPS = (
    ",，、﹐", ".。．｡", ";；", ":：", "?？﹖", "!！﹗", "(（﹙", ")）﹚", "[【〔［", "]】〕］", '"“”「」『』＂', "'‘’＇´", "-—–−﹣－", "…⋯", "<《〈", ">》〉",
)
#: Scripts by code point ranges, and what a space between two characters of one script is.
SCRIPTS = {
    "digit": "0-9",
    "thai": "\u0e00-\u0e7f",
    "kana": "\u3040-\u30ff",
    "han": "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff",
    "hangul": "\uac00-\ud7af",
    "latin": "A-Za-z\u00c0-\u024f",
}
SPACE_ROLE = {"han": "ignorable", "kana": "ignorable", "thai": "boundary", "hangul": "wordDelimiter", "latin": "wordDelimiter", "digit": "wordDelimiter", "other": "wordDelimiter"}
#: Dashes that separate parts of an identifier.
DASHES = "\\-\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
MARKER = ELLIPSIS_MARKER.replace("[SPACE]", f"[{SPACE}{HOLD}]")


@dataclass(frozen=True)
class Sub:
    """Replace what ``pattern`` matches by ``to``."""

    pattern: str
    to: str


@dataclass(frozen=True)
class Spaces(Sub):
    """Drop runs of placeholders at the edges and, between characters of known scripts, where ``pattern`` says so: ``between``
    has the pairs of scripts."""

    between: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Table:
    """Replace single code points."""

    entries: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Lower:
    pass


@dataclass(frozen=True)
class Guarded:
    """Other rules for what lies between the matches of ``keep``."""

    keep: str
    steps: tuple


Rule = Sub | Table | Lower | Guarded


@lru_cache(maxsize=1)
def width_table() -> tuple[tuple[str, str], ...]:
    """Every code point that compatibility normalisation changes on its own, from the Unicode database."""
    out = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        if (n := unicodedata.normalize("NFKC", c)) != c:
            out.append((c, n))
    return tuple(out)


def space_rules(drop_between_cjk: bool = True) -> list[Rule]:
    """Runs of placeholders go at the edges, between different known scripts, and within scripts that ignore spaces."""
    cases, between = [f"^{HOLD}+", f"{HOLD}+$"], []
    for name, chars in SCRIPTS.items() if drop_between_cjk else ():
        others = [n for n in SCRIPTS if n != name or SPACE_ROLE[name] == "ignorable"]
        cases.append(f"(?<=[{chars}]){HOLD}+(?=[{''.join(SCRIPTS[n] for n in others)}])")
        between += [(name, n) for n in others]
    return [Spaces("|".join(cases), "", tuple(between))]


def separators_rule(to: str = " ") -> Sub:
    return Sub(f"(?<=[A-Za-z0-9])[_{DASHES}](?=[A-Za-z0-9])", to)


def camel_rule(to: str = " ") -> Sub:
    return Sub("(?<=[a-z0-9])(?=[A-Z])", to)


def grouping_rule(underscore: bool = False) -> Sub:
    return Sub(f"(?<=[0-9])[,，﹐{'_' if underscore else ''}](?=[0-9]{{3}}(?![0-9]))", "")


@lru_cache(maxsize=1)
def punctuation_table() -> Table:
    return Table(tuple((c, g[0]) for g in PUNCTUATION_GROUPS for c in g[1:]))


def keep_pattern(keep: tuple[str | Raw, ...]) -> str | None:
    """What is kept from punctuation folding: literal texts in their compatibility form, and patterns as they are."""
    quoted = [f"(?:{k.pattern})" if isinstance(k, Raw) else regex.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", unicodedata.normalize("NFKC", k)) for k in keep if k]
    pattern = "|".join(q for q in quoted if q)
    if pattern and regex.match(f"(?:{pattern})$", ""):
        raise ValueError("a pattern to keep must not match the empty text")
    return pattern or None


def rules(o: MatchOptions) -> list[Rule]:
    """The stages in order: width, numbers, identifiers, case, punctuation and spaces."""
    try:
        return list(_rules(o))
    except TypeError:  # options that cannot be hashed
        return _rules.__wrapped__(o)


@lru_cache(maxsize=64)
def _rules(o: MatchOptions) -> list[Rule]:
    out: list[Rule] = []
    if o.ignore_width:
        out += [Table(width_table()), Sub(f"[{ZERO_WIDTH}]", "")]
    if o.number_grouping:
        out.append(grouping_rule(o.grouping_underscore))
    if o.normalize_identifier_separators:
        out.append(separators_rule())
    if o.split_camel_case:
        out.append(camel_rule())
    if o.ignore_case:
        out.append(Lower())
    folds: list[Rule] = [punctuation_table()]
    if o.ignore_punctuation:
        if o.ellipsis and o.preserve_ellipsis:
            folds.append(Sub(MARKER, MARK))
        extra = regex.sub(r"([\[\]\\^&-])", r"\\\1", "".join(o.punctuation_extra))
        folds.append(Sub(f"{o.punctuation_class}|[{extra}]" if extra else o.punctuation_class, HOLD))
    folds.append(Sub(f"[{SPACE}]+", HOLD))
    kept = keep_pattern(o.punctuation_keep) if o.ignore_punctuation else None
    out += [Guarded(kept, tuple(folds))] if kept else folds
    if o.ignore_punctuation == "drop":
        out.append(Sub(HOLD, ""))
    else:
        out += space_rules(o.drop_space_between_cjk)
    return out


def to_column(text: Column, steps: list[Rule]) -> Column:
    """The rules as native expressions."""
    for rule in steps:
        if isinstance(rule, Sub):
            text = F.regexp_replace(text, rule.pattern, rule.to.replace("\\", "\\\\").replace("$", "\\$"))
        elif isinstance(rule, Lower):
            text = F.lower(text)
        elif isinstance(rule, Guarded):
            parts = F.regexp_extract_all(text, F.lit(f"(?s)(?:{rule.keep})|(?:(?!{rule.keep}).)+"), F.lit(0))
            text = F.array_join(F.transform(parts, _unless_kept(rule)), "")
        else:
            single = [(a, b) for a, b in rule.entries if len(b) == 1]
            several = [(a, b) for a, b in rule.entries if len(b) != 1]
            if several:
                # Expansions are rare: only texts that hold one are taken apart.
                column = lambda k: F.split(F.lit(HOLD.join(p[k] for p in several)), HOLD)
                pairs = F.map_from_arrays(column(0), column(1))  # folded to one literal
                chars = "".join(a for a, _ in several)
                apart = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")
                text = F.when(F.translate(text, chars, "") != text, apart).otherwise(text)
            text = F.translate(text, "".join(a for a, _ in single), "".join(b for _, b in single))
    return text


def _unless_kept(rule: Guarded) -> Callable[[Column], Column]:
    return lambda part: F.when(part.rlike(f"(?s)^(?:{rule.keep})$"), part).otherwise(to_column(part, list(rule.steps)))


@dataclass
class Trace:
    """A text with the source interval (code points) of each character."""

    text: str
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, text: str) -> Trace:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1)

    @cached_property
    def points(self) -> np.ndarray:
        """The code points of the text."""
        return np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)

    @classmethod
    def of_points(cls, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> Trace:
        out = cls(points.tobytes().decode("utf-32-le", "surrogatepass"), start, end)
        out.points = points
        return out

    def take(self, pieces: list[tuple[str, np.ndarray, np.ndarray]]) -> Trace:
        if not pieces:
            return Trace("", self.start[:0], self.end[:0])
        return Trace("".join(p[0] for p in pieces), np.concatenate([p[1] for p in pieces]), np.concatenate([p[2] for p in pieces]))

    def span(self, lo: int, hi: int) -> tuple[int, int]:
        """The source interval of text[lo:hi]."""
        return (int(self.start[lo]), max(int(self.start[lo]), int(self.end[hi - 1]))) if lo < hi else (0, 0)


@lru_cache(maxsize=256)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


_TABLES: dict[int, tuple] = {}


def _table(entries: tuple[tuple[str, str], ...]) -> tuple[dict, np.ndarray]:
    """A table as a dict, and which code points it changes; kept by identity, since hashing thousands of entries takes long."""
    held = _TABLES.get(id(entries))
    if held is None or held[0] is not entries:
        if len(_TABLES) >= 16:
            _TABLES.clear()
        held = _TABLES[id(entries)] = (entries, dict(entries), _marked([ord(a) for a, _ in entries]))
    return held[1:]


def _marked(points: list[int]) -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, dtype=bool)
    out[points] = True
    return out


_ONE_CLASS = regex.compile(r"\[(?!\^)(?:[^\[\]\\]|\\.)+\]\+?", regex.S)


@lru_cache(maxsize=64)
def _class(pattern: str) -> np.ndarray | None:
    """The code points of a pattern that is one class of characters, or a run of them; None for other patterns."""
    if not _ONE_CLASS.fullmatch(pattern):
        return None
    return _marked([m.start() for m in regex.finditer(pattern.removesuffix("+"), "".join(map(chr, range(sys.maxunicode + 1))))])


def _spans(t: Trace, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what a pattern matches."""
    members = _class(pattern)
    if members is None:
        found = np.array([m.span() for m in _compiled(pattern).finditer(t.text)], dtype=np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]
    at = np.flatnonzero(members[t.points])
    return _runs(at) if pattern.endswith("+") else (at, at + 1)


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of neighbours among places."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(at[1:] - at[:-1] > 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1


@lru_cache(maxsize=1)
def _script_of() -> np.ndarray:
    """The number of each code point's script, 0 for others."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for k, chars in enumerate(SCRIPTS.values()):
        out[_class(f"[{chars}]")] = k + 1
    return out


@lru_cache(maxsize=8)
def _between(pairs: tuple[tuple[str, str], ...]) -> np.ndarray:
    number = {n: k + 1 for k, n in enumerate(SCRIPTS)}
    out = np.zeros((len(SCRIPTS) + 1,) * 2, dtype=bool)
    for a, b in pairs:
        out[number[a], number[b]] = True
    return out


def _dropped(t: Trace, rule: Spaces) -> tuple[np.ndarray, np.ndarray]:
    """What ``rule`` matches, without its pattern."""
    lo, hi = _runs(np.flatnonzero(t.points == ord(HOLD)))
    if not len(lo):
        return lo, hi
    size = len(t.points)
    last = size - 1 if t.text[-1] == "\n" else size  # a line end at the very end counts as the end
    scripts = _script_of()[t.points]
    gone = _between(rule.between)[scripts[lo - 1], scripts[np.minimum(hi, size - 1)]]
    gone |= (lo == 0) | (hi >= last)
    return lo[gone], hi[gone]


def _outside(size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of so many places lie in none of the spans, which do not overlap."""
    edge = np.zeros(size + 1, dtype=np.int8)
    edge[lo[lo < hi]] += 1
    edge[hi[lo < hi]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) == 0


def _substitute(t: Trace, lo: np.ndarray, hi: np.ndarray, to: str | list[str]) -> Trace:
    """Replace spans, all by one text or each by its own; every character of a replacement covers the whole span, or nothing
    for insertions."""
    if not len(lo):
        return t
    size = len(t.text)
    if isinstance(to, str) and len(to) == 1 and (lo < hi).all():  # the first character of a span becomes the replacement
        points, start, end = t.points.copy(), t.start, t.end
        points[lo] = ord(to)
        if (hi - lo > 1).any():
            end = end.copy()
            end[lo] = t.end[hi - 1]
            keep = _outside(size, lo + 1, hi)
            points, start, end = points[keep], start[keep], end[keep]
        return Trace.of_points(points, start, end)
    keep = _outside(size, lo, hi)
    points, start, end = t.points[keep], t.start[keep], t.end[keep]
    n = np.full(len(lo), len(to)) if isinstance(to, str) else np.array([len(x) for x in to], dtype=np.int64)
    if n.any():
        a = np.zeros(len(lo), dtype=np.int64)
        if size:
            a = np.where(lo < size, t.start[np.minimum(lo, size - 1)], t.end[-1])
        b = np.where(hi > lo, t.end[hi - 1], a) if size else a
        at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), n)
        new = np.frombuffer((to * len(lo) if isinstance(to, str) else "".join(to)).encode("utf-32-le", "surrogatepass"), np.uint32)
        points, start, end = np.insert(points, at, new), np.insert(start, at, np.repeat(a, n)), np.insert(end, at, np.repeat(b, n))
    return Trace.of_points(points, start, end)


def trace(text: str | Trace, steps: list[Rule]) -> Trace:
    """The rules in Python, with coordinates."""
    t = Trace.of(text) if isinstance(text, str) else text
    for rule in steps:
        if isinstance(rule, Sub):
            t = _substitute(t, *(_dropped(t, rule) if isinstance(rule, Spaces) else _spans(t, rule.pattern)), rule.to)
        elif isinstance(rule, Lower):
            low = t.text.lower()
            if len(low) == len(t.text):
                t = Trace(low, t.start, t.end)
            else:  # per character, so that later places do not shift
                at = np.array([i for i, c in enumerate(t.text) if c.lower() != c], dtype=np.int64)
                t = _substitute(t, at, at + 1, [t.text[i].lower() for i in at])
        elif isinstance(rule, Guarded):
            cuts = [0, *(x for m in _compiled(rule.keep).finditer(t.text) for x in m.span()), len(t.text)]
            parts = [Trace(t.text[a:b], t.start[a:b], t.end[a:b]) for a, b in zip(cuts, cuts[1:])]
            parts = [x if k % 2 else trace(x, list(rule.steps)) for k, x in enumerate(parts)]
            t = t.take([(x.text, x.start, x.end) for x in parts])
        else:
            table, members = _table(rule.entries)
            at = np.flatnonzero(members[t.points])
            t = _substitute(t, at, at + 1, [table[t.text[i]] for i in at])
    return t


def normalized(text: str, o: MatchOptions) -> str:
    return trace(text, rules(o)).text
