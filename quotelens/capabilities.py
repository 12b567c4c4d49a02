"""What the matcher can use here, loaded when first asked for; what cannot be loaded is switched off, not an error."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import lru_cache
from typing import Any

from .options import MatchOptions, with_preset

#: Where each capability comes from: module and name. ``register_capability`` adds or replaces one.
_FACTORIES: dict[str, tuple[str, str]] = {
    "markdown": ("quotelens.functions.markdown", "flatten"),
    "fuzzy": ("quotelens.functions.approx", "find"),
    "numerals": ("quotelens.functions.numerals", "numeral_at"),
    "particles": ("quotelens.functions.particles", "guard_list_tagger"),
    "word_segmenter": ("quotelens.functions.segmenters", "word_segmenter"),
    "corpus_search": ("ahocorasick", "Automaton"),
}


@lru_cache(maxsize=None)
def capability(name: str) -> Callable[..., Any] | None:
    """The function behind a capability, loaded once; None where its module or name is missing. Unknown names raise."""
    module, attribute = _FACTORIES[name]
    try:
        return getattr(importlib.import_module(module), attribute, None)
    except ImportError:
        return None


def capabilities() -> dict[str, bool]:
    return {name: capability(name) is not None for name in _FACTORIES}


def register_capability(name: str, module: str, attribute: str) -> None:
    _FACTORIES[name] = (module, attribute)
    capability.cache_clear()


def assembled(preset: str | None = None, **explicit: Any) -> MatchOptions:
    """Options with the defaults of a matcher that nothing was said about: markdown, numerals if they are asked for, and an
    approximate matcher unless the preset is strict. What is given explicitly wins, and what cannot be loaded stays off."""
    wanted: dict[str, Any] = {}
    if capability("markdown"):
        wanted["markdown"] = "commonmark"
    if capability("fuzzy") and preset != "strict":
        wanted["fallbacks"] = ("bitap",)
    if explicit.get("cjk_numerals") and capability("numerals"):
        wanted["cjk_numeral_parser"] = capability("numerals")
    elif explicit.get("cjk_numerals"):
        wanted["cjk_numerals"] = explicit["cjk_numerals"] = False
    return with_preset(preset, **{**wanted, **explicit})
