"""Match options, presets and the constant rows of the result model."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

#: A miss is a row, never null.
NO_MATCH: Mapping[str, Any] = {"index": -1, "length": 0, "kind": "none", "score": 0.0, "occurrences": 0}
KINDS = ("exact", "normalized", "segmented", "fuzzy", "semantic", "none")
#: The marked omission, any mix of the signs in any of the bracket pairs.
ELLIPSIS_MARKER = "[〔\\[【][SPACE]*[.．…略]+[SPACE]*[〕\\]】]"
DEFAULT_IMPLICIT_GAP = 500


@dataclass(frozen=True)
class Raw:
    """A pattern, where a text would be taken literally."""

    pattern: str


@dataclass(frozen=True)
class MatchOptions:
    """Options of the whole ladder; read on the driver and closed over by the plan."""

    preset: str | None = None
    locale: str = "auto"
    ignore_case: bool = True
    ignore_punctuation: bool | str = False  #: False, True or "fold", or "drop"
    punctuation_class: str = r"\p{P}"  #: what counts as punctuation
    punctuation_extra: tuple[str, ...] = ()  #: further characters that count as punctuation
    punctuation_keep: tuple[str | Raw, ...] = ()  #: texts, and patterns over normalised text, that no folding touches
    preserve_ellipsis: bool = True  #: a marked omission is no punctuation
    ignore_width: bool = True
    number_grouping: bool = True
    grouping_underscore: bool = False
    cjk_numerals: bool = False
    cjk_numeral_parser: Callable[[str, int], tuple[int, int] | None] | None = None
    cjk_word_segmenter: Callable[[str], int] | None = None
    split_camel_case: bool = False
    normalize_identifier_separators: bool = False
    ellipsis: bool = True
    markdown: str | None = None  #: None, "regex" or "commonmark"
    excerpt_is_markdown: bool = False
    trim_markdown_edges: bool = False
    expand_markers: bool = True
    allow_cross_block: bool = True
    max_cross_blocks: float = math.inf
    fallbacks: tuple[str, ...] = ()  #: names of registered approximate matchers, tried in order
    min_fallback_score: float = 0.75
    check_polarity: bool = True
    negations: tuple[str, ...] = ()  #: words added to the negation lexicon
    non_negations: tuple[str, ...] = ()
    ignore_particles: bool | Callable[[str], set[int]] = False
    min_segment_length: int = 4
    max_gap: float = math.inf
    implicit_ellipsis: bool | float = False
    drop_space_between_cjk: bool = True
    given: frozenset = field(default_factory=frozenset, compare=False)

    @property
    def implicit_gap(self) -> float | None:
        if self.implicit_ellipsis is False:
            return None
        return DEFAULT_IMPLICIT_GAP if self.implicit_ellipsis is True else float(self.implicit_ellipsis)


# The three presets.
STRICT = {"ignore_case": True, "ignore_width": True, "ignore_punctuation": False, "ignore_particles": False, "number_grouping": True, "grouping_underscore": False, "cjk_numerals": False, "split_camel_case": False, "normalize_identifier_separators": False, "ellipsis": False, "allow_cross_block": False, "max_cross_blocks": 1, "trim_markdown_edges": False, "expand_markers": True, "check_polarity": True, "fallbacks": ()}
DEFAULT_PRESET = {"ignore_case": True, "ignore_width": True, "ignore_punctuation": False, "ignore_particles": False, "number_grouping": True, "grouping_underscore": False, "cjk_numerals": False, "split_camel_case": False, "normalize_identifier_separators": False, "ellipsis": True, "allow_cross_block": True, "max_cross_blocks": math.inf, "trim_markdown_edges": False, "expand_markers": True, "check_polarity": True, "min_segment_length": 4, "fallbacks": ()}
LOOSE = {"ignore_case": True, "ignore_width": True, "ignore_punctuation": True, "ignore_particles": False, "number_grouping": True, "grouping_underscore": True, "cjk_numerals": False, "split_camel_case": False, "normalize_identifier_separators": True, "ellipsis": True, "allow_cross_block": True, "max_cross_blocks": math.inf, "implicit_ellipsis": True, "trim_markdown_edges": False, "expand_markers": True, "check_polarity": True, "min_segment_length": 3, "min_fallback_score": 0.6, "fallbacks": ()}
PRESETS = {"strict": STRICT, "default": DEFAULT_PRESET, "loose": LOOSE}


def with_preset(preset: str | None = None, **explicit: Any) -> MatchOptions:
    """Options of a preset; what is given explicitly wins. Unknown presets and options raise."""
    known = {f.name for f in fields(MatchOptions)}
    if unknown := set(explicit) - known:
        raise TypeError(f"unknown options: {sorted(unknown)}")
    if preset is not None and preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    base = MatchOptions(preset=preset)
    values = {**(PRESETS[preset] if preset else {}), **explicit}
    out = replace(base, **values, given=frozenset(explicit))
    return out if out.allow_cross_block else replace(out, max_cross_blocks=min(1, out.max_cross_blocks))


def is_hit(match: Mapping[str, Any]) -> bool:
    return match["kind"] != "none"


def with_keep(o: MatchOptions, *keep: str | Raw) -> MatchOptions:
    """``o`` with more to keep from punctuation folding; unchanged where nothing is folded or omissions are not preserved."""
    return replace(o, punctuation_keep=o.punctuation_keep + keep) if o.ignore_punctuation and o.preserve_ellipsis else o
