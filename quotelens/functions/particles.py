"""Structural particles 的, 地 and 得, folded to one sign wherever they are not part of a content word."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import regex

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles, their tags, and content words that hold one of the signs.
PARTICLES = "的地得"
PARTICLE_TAGS = frozenset({"uj", "uv", "ud"})
SOLID_WORDS = tuple(
    "大地 土地 地方 地址 地点 地图 地位 地区 地面 地球 地铁 基地 场地 目的地 所在地 根据地 殖民地 心地 见地 境地 内地 外地 本地 实地 原地 工地 "
    "地下 地板 地质 地形 地域 地毯 地道 地主 地步 得到 懂得 值得 获得 记得 觉得 显得 使得 认得 晓得 舍得 懒得 免得 不见得 了不得 不得已 不得不 得意 得逞 "
    "得罪 得利 得失 得当 得体 得分 得手 目的 的确 的士 标的 一的 有的是 当家的 得奖 得胜 得志 得宠".split()
)


def particle_pattern(extra: Iterable[str] = ()) -> str:
    """A particle that no listed word covers, as one pattern of lookarounds."""
    guards = []
    for word in sorted({*SOLID_WORDS, *extra}):
        for i, c in enumerate(word):
            if c in PARTICLES:
                before, after = regex.escape(word[:i]), regex.escape(word[i + 1 :])
                guards.append(f"(?!(?<={before}){c}{after})" if before else f"(?!{c}{after})")
    return "".join(guards) + f"[{PARTICLES}]"


def fold_particles(text: Column, extra: Iterable[str] = ()) -> Column:
    return F.regexp_replace(text, particle_pattern(extra), PARTICLES[0])


def guard_list_tagger(extra: Iterable[str] = ()) -> Callable[[str], set[int]]:
    """Places of one string at which particles may fold."""
    pattern = regex.compile(particle_pattern(extra))
    return lambda text: {m.start() for m in pattern.finditer(text)}


def word_tagger(tag: Callable[[str], list[tuple[str, str]]], max_length: int = 200_000) -> Callable[[str], set[int]]:
    """A tagger from any (word, tag) segmenter; over-long and empty texts fold nothing."""

    def places(text: str) -> set[int]:
        if not text or len(text) > max_length:
            return set()
        out, at = set(), 0
        for word, kind in tag(text):
            if kind in PARTICLE_TAGS and word in PARTICLES:
                out.add(at)
            at += len(word)
        return out

    return places
