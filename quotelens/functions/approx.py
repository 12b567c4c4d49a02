"""Approximate matching: a seed is found near its expected place, and a common-subsequence alignment of the window
around it gives span and score. Distances are vectorised over the searched text, one step per pattern character."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice

import numpy as np
import regex

#: The longest and the shortest seed, the places tried for one, and how many occurrences are told apart.
SEED = 24
SHORTEST = 4
TRIES = 5
TOLD_APART = 20


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    score: float


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def pick_seed(hay: str, needle: str, longest: int = SEED) -> tuple[str, int] | None:
    """A piece of the needle to look for, and its place there: of pieces at evenly spread places the one that occurs least
    often but does occur; where none does, the one with most characters that the searched text knows."""
    width = min(longest, len(needle))
    if width < SHORTEST:
        return None
    places = np.unique(np.linspace(0, len(needle) - width, TRIES).astype(int)).tolist()
    pieces = {at: needle[at : at + width] for at in places}
    often = {at: sum(1 for _ in islice(regex.finditer(regex.escape(x), hay, overlapped=True), TOLD_APART)) for at, x in pieces.items()}
    if any(often.values()):
        best = min((at for at in places if often[at]), key=often.get)
    else:
        known = set(hay)
        best = max(places, key=lambda at: sum(map(known.__contains__, pieces[at])))
    return pieces[best], best


def edit_distances(text: str, pattern: str) -> np.ndarray:
    """For each place, the least edits between the pattern and a substring that starts there."""
    t, n = _codes(text)[::-1], len(text)
    step = np.arange(n + 1)
    row = np.zeros(n + 1, dtype=np.int64)
    for i, c in enumerate(_codes(pattern)[::-1]):
        new = np.empty(n + 1, dtype=np.int64)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    return row[::-1][:n]


def match_near(text: str, pattern: str, place: int, threshold: float, distance: float) -> int:
    """The place of least cost (share of edits, plus remoteness over ``distance``) within ``threshold``, or -1."""
    if not text or not pattern:
        return -1
    away = np.abs(np.arange(len(text)) - place)
    cost = edit_distances(text, pattern) / len(pattern) + (0 if math.isinf(distance) else away / max(distance, 1))
    best = int(np.lexsort((away, cost))[0])
    return best if cost[best] <= threshold else -1


def match_relaxed(text: str, pattern: str, place: int, threshold: float, distance: float) -> int:
    """``match_near``; then without nearness if the seed does not occur, else with any edits, and then with neither."""
    at = match_near(text, pattern, place, threshold, distance)
    if at >= 0:
        return at
    if pattern not in text:
        return match_near(text, pattern, place, threshold, math.inf)
    at = match_near(text, pattern, place, 1.0, distance)
    return at if at >= 0 else match_near(text, pattern, place, 1.0, math.inf)


def common_runs(a: str, b: str) -> list[tuple[int, int, int]]:
    """Runs (place in a, place in b, length) of a longest common subsequence, of those the one that spans least of ``a``."""
    x, y = _codes(a), _codes(b)
    most = len(x) + 1
    table = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int64)
    for i in range(len(x)):
        row = np.maximum(table[i] - 1, 0)
        met = np.where(y == x[i], most + table[i, :-1], 0)
        row[1:] = np.maximum(row[1:], met)
        table[i + 1] = np.maximum.accumulate(row)
    i, j = int(table[:, -1].argmax()), len(y)
    runs: list[tuple[int, int, int]] = []
    while i and j and table[i, j] > 0:
        if table[i, j] == table[i, j - 1]:
            j -= 1
        elif x[i - 1] == y[j - 1] and table[i, j] == most + table[i - 1, j - 1]:
            i, j = i - 1, j - 1
            if runs and runs[-1][0] == i + 1 and runs[-1][1] == j + 1:
                runs[-1] = (i, j, runs[-1][2] + 1)
            else:
                runs.append((i, j, 1))
        else:
            i -= 1
    return runs[::-1]


def char_f1(common: int, a: int, b: int) -> float:
    return 2 * common / (a + b) if a + b else 0.0


def best_span(window: str, needle: str) -> Candidate | None:
    """The aligned part of the window; stray matches at its edges go while that raises the score."""
    runs = common_runs(window, needle)
    if not runs:
        return None
    score = lambda r: char_f1(sum(n for *_, n in r), r[-1][0] + r[-1][2] - r[0][0], len(needle))
    while len(runs) > 1:
        options = [runs[1:], runs[:-1]]
        best = max(options, key=score)
        if score(best) <= score(runs):
            break
        runs = best
    return Candidate(runs[0][0], runs[-1][0] + runs[-1][2], score(runs))


def _closest(needle: str, seed: str, offset: int, hay: str, threshold: float, distance: float, slack: int) -> Candidate | None:
    """The alignment around the place of the seed that is cheapest, seen from its first verbatim occurrence."""
    at = match_relaxed(hay, seed, max(0, hay.find(seed)), threshold, distance)
    if at < 0:
        return None
    lo = max(0, at - offset - slack // 2)
    span = best_span(hay[lo : at - offset + len(needle) + slack], needle)
    return Candidate(lo + span.start, lo + span.end, span.score) if span else None


def find(needle: str, hay: str, threshold: float = 0.5, distance: float = 1000, slack: int = 64, most: int = 1, least: float = 0.0) -> list[Candidate]:
    """Up to ``most`` approximate occurrences that do not overlap, best first.

    The searched text is a set of free stretches: the best candidate of all stretches is taken, and what lies before and
    after it are two new ones, each searched on its own.
    """
    chosen = pick_seed(hay, needle)
    if not chosen:
        return []
    out: list[Candidate] = []
    waiting: list[tuple[float, int, int, int, int]] = []

    def search(lo: int, hi: int) -> None:
        c = _closest(needle, *chosen, hay[lo:hi], threshold, distance, slack)
        if c and c.score > 0 and c.score >= least:
            heapq.heappush(waiting, (-c.score, lo + c.start, lo + c.end, lo, hi))

    search(0, len(hay))
    while waiting:
        score, start, end, lo, hi = heapq.heappop(waiting)
        out.append(Candidate(start, end, -score))
        if len(out) == most:
            break
        search(lo, start)
        search(end, hi)
    return sorted(out, key=lambda c: -c.score)


#: Named approximate matchers: the current profile and the stricter older one.
MATCHERS: dict[str, Callable[[str, str], list[Candidate]]] = {
    "bitap": lambda needle, hay: find(needle, hay),
    "bitap-strict": lambda needle, hay: find(needle, hay, threshold=0.4),
}


class GramFilter:
    """Which of many needles may occur in a text within some edits, by counts of common pieces in windows of the text.

    A needle of length L that occurs with at most k single-character edits shares L - q + 1 - q k pieces of q characters with
    a stretch of at most L + k characters of the text, and their places there, less those in the needle, differ by k at
    most. k is two thirds of (1 - floor) L, one edit in six characters at a floor of 0.75; pieces are as long as that leaves a
    telling number of them. Nothing within k edits is missed.
    """

    def __init__(self, needles: list[str], floor: float, group: int = 256):
        plans: dict[int, list[tuple[int, int, int]]] = {}
        for i, x in enumerate(needles):
            if len(x) < SHORTEST:  # no seed, no fuzzy match
                continue
            edits = int(2 * (1 - floor) * len(x) / 3 + 1e-9)
            counts = {q: len(x) - q + 1 - q * edits for q in (5, 4, 3, 2, 1)}
            q = next((q for q, n in counts.items() if n >= max(2, 0.15 * len(x))), 1)
            plans.setdefault(q, []).append((i, max(1, counts[q]), len(x) - q + 1 + edits))
        self.groups = []
        for q, rows in plans.items():
            for at in range(0, len(rows), group):
                part = rows[at : at + group]
                sets = [np.unique(self._grams(needles[i], q)) for i, *_ in part]
                vocabulary = np.unique(np.concatenate(sets))
                held = np.zeros((len(vocabulary) + 1, len(part)), dtype=np.uint8)
                for k, own in enumerate(sets):
                    held[np.searchsorted(vocabulary, own), k] = 1
                self.groups.append((q, vocabulary, held, [self._sorted(needles[i], q) for i, *_ in part], *(np.array(c) for c in zip(*part))))

    @classmethod
    def _sorted(cls, needle: str, q: int) -> tuple[np.ndarray, np.ndarray]:
        grams = cls._grams(needle, q)
        order = np.argsort(grams, kind="stable")
        return grams[order], order

    @staticmethod
    def _grams(text: str, q: int) -> np.ndarray:
        codes = _codes(text).astype(np.uint64)
        n = max(0, len(codes) - q + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(q):
            out = out * np.uint64(0x110003) + codes[j : j + n]
        return out

    def near(self, text: str, step: int = 1 << 14) -> set[int]:
        out: set[int] = set()
        for q, vocabulary, held, pieces, ids, least, width in self.groups:
            grams = self._grams(text, q)
            place = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
            place[vocabulary[place] != grams] = len(vocabulary)
            reach = int(width.max())
            for at in range(0, max(1, len(place)), step):
                rows = place[at : at + step + reach]
                enough = np.flatnonzero(held[rows].sum(axis=0, dtype=np.int32) >= least)
                if not len(enough):
                    continue
                total = np.zeros((len(rows) + 1, len(enough)), dtype=np.int32)
                np.cumsum(held[rows][:, enough], axis=0, out=total[1:])
                for k, column in zip(enough, total.T):
                    w = min(int(width[k]), len(rows))
                    if int(ids[k]) not in out and (column[w:] - column[: len(column) - w]).max() >= least[k] and self._aligned(grams[at : at + step + reach], *pieces[k], int(width[k]), int(least[k])):
                        out.add(int(ids[k]))
        return out

    @staticmethod
    def _aligned(grams: np.ndarray, own: np.ndarray, place: np.ndarray, width: int, least: int) -> bool:
        """Whether enough pieces are common at places that differ by no more than the edits allow."""
        lo, hi = np.searchsorted(own, grams), np.searchsorted(own, grams, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(grams)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        shift = at - place[np.repeat(lo, n) + nth] + len(own)
        total = np.concatenate([[0], np.cumsum(np.bincount(shift, minlength=len(grams) + len(own) + 1))])
        band = min(width - len(own) + 1, len(total) - 1)
        return bool((total[band:] - total[: len(total) - band]).max() >= least)


def register(name: str, matcher: Callable[[str, str], list[Candidate]]) -> None:
    MATCHERS[name] = matcher
