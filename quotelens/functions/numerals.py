"""Chinese numerals to digits: a parser hook and a default parser of units, sections and plain digit runs."""

from __future__ import annotations

import re

# Digits, units, signs and points, in both scripts.
DIGITS = {c: v for v, cs in enumerate(("零〇", "一壹", "二贰两", "三叁", "四肆", "五伍", "六陆", "七柒", "八捌", "九玖")) for c in cs}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
SECTIONS = {"万": 10**4, "萬": 10**4, "亿": 10**8, "億": 10**8, "兆": 10**12}
MINUS, POINT = "负負", "点點"
CHINESE_NUMERAL_CHARS = frozenset({*DIGITS, *UNITS, *SECTIONS, *MINUS, *POINT})
LONGEST = 16
_RUN = re.compile("[" + "".join(sorted(CHINESE_NUMERAL_CHARS)) + "]+")
_SPOKEN = re.compile(f"([{MINUS}]?)([^{MINUS}{POINT}]+)(?:[{POINT}]([{''.join(DIGITS)}]+))?")


def _whole(text: str) -> int | None:
    if all(c in DIGITS for c in text):
        return int("".join(str(DIGITS[c]) for c in text))
    total = section = 0
    digit: int | None = None
    last_unit = last_section = 10**20
    for c in text:
        if c in DIGITS:
            if digit:
                return None
            digit = DIGITS[c]
        elif c in UNITS:
            if UNITS[c] >= last_unit:
                return None
            section += (1 if digit is None and not section else digit or 0) * UNITS[c]
            if digit is None and section == 0:
                return None
            last_unit, digit = UNITS[c], None
        else:
            if SECTIONS[c] >= last_section:
                return None
            whole = section + (digit or 0)
            if not whole:
                return None
            total += whole * SECTIONS[c]
            section, digit, last_section, last_unit = 0, None, SECTIONS[c], 10**20
    return total + section + (digit or 0)


def parse_numeral(text: str) -> int | str | None:
    """The value of a whole numeral, signed, as text where it has decimals; or None."""
    m = _SPOKEN.fullmatch(text)
    value = _whole(m[2]) if m else None
    if value is None:
        return None
    if m[3]:
        return ("-" if m[1] else "") + f"{value}." + "".join(str(DIGITS[c]) for c in m[3])
    return -value if m[1] else value


def numeral_at(text: str, at: int) -> tuple[int | str, int] | None:
    """The longest numeral of at most 16 characters at a place: value and length."""
    m = _RUN.match(text, at)
    for n in range(min(LONGEST, len(m.group())) if m else 0, 0, -1):
        if (value := parse_numeral(text[at : at + n])) is not None:
            return value, n
    return None
