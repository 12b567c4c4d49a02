"""Markdown flattening: visible text with source intervals, blocks and inline constructs.

Two flatteners: ``regex_flatten``, a scan over inline signs, and ``flatten``, a block and inline parser for the usual
subset of CommonMark with tables, strike-through and front matter.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import regex

from .rules import Trace

FRONT_MATTER = regex.compile(r"^\ufeff?---\r?\n.*?\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)", regex.S)
ENTITY = regex.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
ESCAPE = regex.compile(r"\\([!-/:-@\[-`{-~])")
#: The named entities that are decoded.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


@dataclass
class Flat:
    """Visible text; blocks (start, end, source start, source end); constructs (outer lo, hi, inner lo, hi, parent)."""

    trace: Trace
    blocks: list[tuple[int, int, int, int]]
    constructs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    inside: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  #: the innermost construct of each character, or -1
    separator: np.ndarray | None = None

    @property
    def text(self) -> str:
        return self.trace.text


def entity(name: str) -> str:
    if name[0] != "#":
        return NAMED.get(name, "")
    value = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(value) if value <= 0x10FFFF and not 0xD800 <= value <= 0xDFFF else ""


class _Out:
    """Runs of visible text: text, source start and end, construct, whether its places are those of the source, whether it separates."""

    def __init__(self):
        self.runs: list[tuple[str, int, int, int, bool, bool]] = []
        self.size = 0
        self.constructs: list[tuple[int, int, int, int, int]] = []

    def put(self, text: str, lo: int, hi: int, owner: int, sep: bool = False) -> None:
        if text:
            self.runs.append((text, lo, hi, owner, False, sep))
            self.size += len(text)

    def run(self, src: str, lo: int, hi: int, owner: int) -> None:
        """Source characters as they are."""
        if text := src[lo:hi]:
            self.runs.append((text, lo, lo + 1, owner, True, False))
            self.size += len(text)

    def flat(self, blocks) -> Flat:
        text, lo, hi, owner, plain, sep = zip(*self.runs) if self.runs else ((),) * 6
        n = np.array([len(x) for x in text], dtype=np.int64)
        lo, hi, owner = (np.array(x, dtype=np.int64) for x in (lo, hi, owner))
        past = np.repeat(np.array(plain, dtype=bool), n) * (np.arange(self.size) - np.repeat(np.cumsum(n) - n, n))
        t = Trace("".join(text), np.repeat(lo, n) + past, np.repeat(hi, n) + past)
        return Flat(t, blocks, self.constructs, np.repeat(owner, n), np.repeat(np.array(sep, dtype=bool), n))


def identity_flat(src: str) -> Flat:
    t = Trace.of(src)
    return Flat(t, [(0, len(src), 0, len(src))], [], np.full(len(src), -1), np.zeros(len(src), dtype=bool))


#: What the scanner knows of markup, in order of precedence; all else is visible as it stands.
_MARKUP = regex.compile(
    r"""
    (?P<hidden> !\[ [^\]]*+ \] \( [^)]*+ \)                           # a picture
      | ^ (?=[^\n]*\|) (?=[^\n]*-) [ \t|:-]++ (?:\n|\Z)               # the rule below a table's head
      | ^ (?: \#{1,6}\s+ | > [ \t]? | [-*+]\s+ | [0-9]+\.\s+ | \|\s* )  # what opens a heading, quote, item or row
      | (?!```) [*_~`]{1,3} )                                          # inline signs
    | ``` [^\n]*+ \n? (?P<code> .*? ) (?: ``` | \Z )
    | \[ (?P<label> [^\]]*+ ) \] \( [^)]*+ \)
    | & (?P<entity> \#? [0-9A-Za-z]{1,32} ) ;
    | \\ (?P<bare> . )
    """,
    regex.X | regex.S | regex.M,
)


def regex_flatten(src: str) -> Flat:
    """An approximate flattener without a parser: one block, one left-to-right pass over signs that look like markup."""
    out, at = _Out(), 0
    for m in _MARKUP.finditer(src):
        out.run(src, at, m.start(), -1)
        at = m.end()
        if m["hidden"] is not None:
            continue
        if m["entity"] is not None:
            whole = ENTITY.fullmatch(m[0])
            out.put((whole and entity(whole[1])) or "", m.start(), at, -1)
            if not (whole and entity(whole[1])):
                out.run(src, m.start(), at, -1)
        elif m["bare"] is not None:
            out.put(m["bare"], m.start(), at, -1)
        else:
            out.run(src, *m.span("code" if m["code"] is not None else "label"), -1)
    out.run(src, at, len(src), -1)
    flat = out.flat([])
    flat.blocks = [(0, len(flat.text), 0, len(src))]
    return flat


_FENCE = regex.compile(r"^( {0,3})(`{3,}|~{3,})[^\n]*$")
_HEADING = regex.compile(r"^ {0,3}#{1,6}(?:[ \t]+|$)")
_BREAK = regex.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = regex.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_QUOTE = regex.compile(r"^ {0,3}> ?")
_ITEM = regex.compile(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)(?:\[[ xX]\][ \t]+)?")
_DEFINITION = regex.compile(r"^ {0,3}\[[^\]]+\]:")
_HTML = regex.compile(r"^ {0,3}<(?:!--|/?[A-Za-z][^>]*>?|\?|!)")
_DELIMITER = regex.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def flatten(src: str, separator: str = "\n") -> Flat:
    """Visible text of a markdown source; what cannot be parsed stays as it is."""
    out = _Out()
    blocks: list[tuple[int, int, int, int]] = []
    start = m.end() if (m := FRONT_MATTER.match(src)) else 0
    lines: list[tuple[int, int]] = []
    at = start
    while at < len(src):
        end = src.find("\n", at)
        end = len(src) if end < 0 else end
        lines.append((at, end))
        at = end + 1

    def emit(lo: int, hi: int, write) -> None:
        begin = out.size
        write()
        if out.size > begin:
            blocks.append((begin, out.size, lo, hi))
            out.put(separator, hi, hi, -1, True)

    bodies: dict[int, tuple[int, str]] = {}

    def body(k: int) -> tuple[int, str]:
        """A line without its containers' signs."""
        if k not in bodies:
            lo, hi = lines[k]
            bodies[k] = uncontained(lo, hi) if lo < hi else (lo, "")
        return bodies[k]

    def uncontained(lo: int, hi: int) -> tuple[int, str]:
        while True:
            m = _QUOTE.match(line := src[lo:hi]) or _ITEM.match(line)
            if not m or not m.group() or _BREAK.match(line.rstrip("\r")):
                return lo, line.rstrip("\r")
            lo += m.end()

    k = 0
    while k < len(lines):
        lo, text = body(k)
        if not text.strip():
            k += 1
        elif m := _FENCE.match(text):
            close = regex.compile(r"^ {0,3}" + regex.escape(m.group(2)[0]) + "{" + str(len(m.group(2))) + r",}[ \t]*$")
            j = k + 1
            while j < len(lines) and not close.match(body(j)[1]):
                j += 1
            inner = [body(i) if _QUOTE.match(src[lines[i][0] : lines[i][1]]) else (lines[i][0], src[lines[i][0] : lines[i][1]]) for i in range(k + 1, j)]
            hi = lines[min(j, len(lines) - 1)][1]

            def code(inner=inner, hi=hi, lo=lo) -> None:
                out.constructs.append((lo, hi, inner[0][0] if inner else hi, inner[-1][0] + len(inner[-1][1]) if inner else hi, -1))
                for n, (p, t) in enumerate(inner):
                    out.run(src, p, p + len(t), len(out.constructs) - 1)
                    if n + 1 < len(inner):
                        out.put("\n", p + len(t), p + len(t) + 1, len(out.constructs) - 1)

            emit(lo, hi, code)
            k = j + 1
        elif _HEADING.match(text):
            head = _HEADING.match(text).end()
            inner = regex.sub(r"(?:[ \t]+#+)?[ \t]*$", "", text[head:])
            emit(lo, lo + len(text), lambda p=lo + head, t=inner: _inline(out, src, p, p + len(t)))
            k += 1
        elif _BREAK.match(text) or _DEFINITION.match(text):
            k += 1
        elif _HTML.match(text):
            while k < len(lines) and body(k)[1].strip():
                k += 1
        elif k + 1 < len(lines) and "|" in text and _DELIMITER.match(body(k + 1)[1]) and "-" in body(k + 1)[1]:
            rows = [(lo, text)]
            j = k + 2
            while j < len(lines) and "|" in (row := body(j))[1]:
                rows.append(row)
                j += 1

            def table(rows=rows) -> None:
                for p, t in rows:
                    for c in regex.finditer(r"(?:[^|\\]|\\.)+", t):
                        cell = c.group()
                        a = p + c.start() + len(cell) - len(cell.lstrip())
                        _inline(out, src, a, a + len(cell.strip()))

            emit(lo, lines[j - 1][1], table)
            k = j
        else:
            parts = [(lo, text)]
            j = k + 1
            while j < len(lines):
                p, t = body(j)
                raw = src[lines[j][0] : lines[j][1]]
                if not t.strip() or _FENCE.match(t) or _HEADING.match(t) or _ITEM.match(raw) or (_QUOTE.match(raw) and not _QUOTE.match(src[lines[k][0] : lines[k][1]])) or _HTML.match(t):
                    break
                if _SETEXT.match(t) or _BREAK.match(t):
                    break
                parts.append((p, t))
                j += 1
            if j < len(lines) and _SETEXT.match(body(j)[1]):
                j += 1
            last = parts[-1][0] + len(parts[-1][1])

            def paragraph(parts=parts) -> None:
                for n, (p, t) in enumerate(parts):
                    a = p + len(t) - len(t.lstrip())
                    b = p + len(t.rstrip())
                    _inline(out, src, a, b)
                    if n + 1 < len(parts):
                        out.put("\n", p + len(t), p + len(t) + 1, -1)

            # A construct may run over line ends if no container sign is between the lines.
            if all(parts[n + 1][0] == parts[n][0] + len(parts[n][1]) + 1 for n in range(len(parts) - 1)):
                a = parts[0][0] + len(parts[0][1]) - len(parts[0][1].lstrip())
                emit(lo, last, lambda a=a, b=parts[-1][0] + len(parts[-1][1].rstrip()): _inline(out, src, a, b))
            else:
                emit(lo, last, paragraph)
            k = j
    return out.flat(blocks)


_CODE = regex.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", regex.S)
_IMAGE = regex.compile(r"!\[(?:[^\[\]\\]|\\.)*\](?:\((?:[^()\\]|\\.|\([^()]*\))*\)|\[[^\]]*\])")
_LINK = regex.compile(r"\[((?:[^\[\]\\]|\\.|!?\[(?:[^\[\]\\]|\\.)*\](?:\([^()]*\))?)*)\](?:\((?:[^()\\]|\\.|\([^()]*\))*\)|\[[^\]]*\])")
_AUTO = regex.compile(r"<((?:https?|mailto|ftp):[^ <>]*|[^ <>@]+@[^ <>]+)>")
_TAG = regex.compile(r"<(?:!--.*?-->|/?[A-Za-z][^<>]*>)", regex.S)
_NEXT = regex.compile(r"[\\&`!\[<*_~\r]| {2,}\r?\n")
_HARD = regex.compile(r" {2,}\r?\n")
_MARKS = regex.compile(r"(\*{1,3}|_{1,3}|~{1,2})(?=\S)")


def _inline(out: _Out, src: str, at: int, end: int, owner: int = -1) -> None:
    """Inline content of src[at:end]."""

    def nested(lo: int, hi: int, a: int, b: int) -> None:
        out.constructs.append((lo, hi, a, b, owner))
        _inline(out, src, a, b, len(out.constructs) - 1)

    while at < end:
        c = src[at]
        if c == "\\" and (m := ESCAPE.match(src, at, end)):
            out.put(m.group(1), at, m.end(), owner)
            at = m.end()
        elif c == "\\" and at + 1 < end and src[at + 1] == "\n":
            at += 1
        elif c == "&" and (m := ENTITY.match(src, at, end)) and (value := entity(m.group(1))):
            out.put(value, at, m.end(), owner)
            at = m.end()
        elif c == "`" and (m := _CODE.match(src, at, end)):
            a, b = m.span(2)
            if b - a > 2 and src[a] == src[b - 1] == " ":
                a, b = a + 1, b - 1
            out.constructs.append((at, m.end(), a, b, owner))
            out.run(src, a, b, len(out.constructs) - 1)
            at = m.end()
        elif c == "!" and (m := _IMAGE.match(src, at, end)):
            at = m.end()
        elif c == "[" and (m := _LINK.match(src, at, end)):
            nested(at, m.end(), m.start(1), m.end(1))
            at = m.end()
        elif c == "<" and (m := _AUTO.match(src, at, end)):
            nested(at, m.end(), m.start(1), m.end(1))
            at = m.end()
        elif c == "<" and (m := _TAG.match(src, at, end)):
            at = m.end()
        elif c in "*_~" and (m := _MARKS.match(src, at, end)) and (close := _closing(src, m, end)) is not None:
            nested(at, close + len(m.group(1)), m.end(), close)
            at = close + len(m.group(1))
        elif c == "\r":
            at += 1
        elif c == " " and _HARD.match(src, at, end):
            at = src.index("\n", at)
        else:
            m = _NEXT.search(src, at + 1, end)
            stop = m.start() if m else end
            out.run(src, at, stop, owner)
            at = stop


def _closing(src: str, m: regex.Match, end: int) -> int | None:
    """The place of the run that closes an emphasis, or None if the signs are plain text."""
    sign, n = m.group(1)[0], len(m.group(1))
    if sign == "_" and m.start() and (src[m.start() - 1].isalnum() or src[m.start() - 1] == "_"):
        return None
    at = m.end()
    while (at := src.find(sign * n, at, end)) >= 0:
        run = at
        while run < end and src[run] == sign:
            run += 1
        if src[at - 1] == "\\" or src[at - 1].isspace():
            at = run
        elif sign == "_" and run < end and src[run].isalnum():
            at = run
        elif run - at == n or (n == 1 and run - at == 3) or (n == 2 and run - at >= 2):
            return run - n if run - at > n else at
        else:
            at = run
    return None


def joined(flat: Flat) -> Flat | None:
    """The view without block separators, or None if there are none."""
    if flat.separator is None or not flat.separator.any():
        return None
    keep = ~flat.separator
    t = flat.trace
    place = np.concatenate([[0], np.cumsum(keep)])
    view = Trace.of_points(t.points[keep], t.start[keep], t.end[keep])
    blocks = [(int(place[a]), int(place[b]), c, d) for a, b, c, d in flat.blocks]
    return Flat(view, blocks, flat.constructs, flat.inside[keep], np.zeros(len(view.text), dtype=bool))


def expand_to_markers(flat: Flat, first: int, last: int, lo: int, hi: int) -> tuple[int, int]:
    """Each end takes in the signs of the innermost construct whose content edge it touches."""
    around = lambda at: flat.constructs[flat.inside[at]] if 0 <= at < len(flat.inside) and flat.inside[at] >= 0 else None
    before, after = around(first), around(last)
    if before and lo <= before[2]:
        lo = min(lo, before[0])
    if after and hi >= after[3]:
        hi = max(hi, after[1])
    return lo, hi


def trim_edges(text: str, at: int, length: int) -> tuple[int, int]:
    """A span without markup signs and spaces at its edges."""
    signs = "*_`~#>|-\\ \t\r\n"
    end = at + length
    while at < end and text[at] in signs:
        at += 1
    while end > at and text[end - 1] in signs:
        end -= 1
    return at, end - at


class CachedFlattener:
    """A flattener that keeps its last results, by document id where one is known and by the text itself otherwise.

    Texts of one id are taken to be the same, so ``flatten_by_id`` does not look at the text of an id it holds. Options of a
    match have no part in the key: other options do not flatten again.
    """

    def __init__(self, base: Callable[[str], Flat], most: int = 32, id_of: Callable[[str], str | None] | None = None):
        self.base, self.most, self.id_of = base, most, id_of
        self.held: OrderedDict[tuple[str, str], Flat] = OrderedDict()

    def _kept(self, key: tuple[str, str], src: str) -> Flat:
        if key not in self.held:
            self.held[key] = self.base(src)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]

    def flatten(self, src: str) -> Flat:
        name = self.id_of(src) if self.id_of else None
        return self._kept(("text", src) if name is None else ("id", name), src)

    __call__ = flatten

    def flatten_by_id(self, name: str, src: str) -> Flat:
        return self._kept(("id", name), src)

    def clear(self) -> None:
        self.held.clear()

    def __len__(self) -> int:
        return len(self.held)


FLATTENERS = {"commonmark": flatten, "regex": regex_flatten}
