"""Word segmenters by locale, kept by the worker that made them: locales of profiles for good, others while they are in use."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import regex

from .scalars import LOCALES, PROFILES, WORD_TOKEN, profile_for

#: How many segmenters of profile locales and of other locales are kept.
PINNED = 64
RECENT = 32
_LOCALE = regex.compile(r"[A-Za-z]{2,8}(?:[-_][A-Za-z0-9]{1,8})*")
_TOKENS = regex.compile(WORD_TOKEN)
Segmenter = Callable[[str], list[tuple[int, str]]]


def _made(locale: str) -> Segmenter:
    _, _, granularity, _ = profile_for(locale)
    if granularity == "char":
        return lambda text: list(enumerate(text))
    return lambda text: [(m.start(), m.group()) for m in _TOKENS.finditer(text)]


_pinned = lru_cache(maxsize=PINNED)(_made)
_recent = lru_cache(maxsize=RECENT)(_made)
_OWN = {*LOCALES, *(p[3] for p in PROFILES.values())}


def word_segmenter(locale: str = "en") -> Segmenter:
    """Places and words of a text, as its locale cuts them. What is no locale counts as ``en``."""
    name = locale.replace("_", "-").lower() if isinstance(locale, str) and _LOCALE.fullmatch(locale) else "en"
    return _pinned(name) if name in _OWN else _recent(name)
