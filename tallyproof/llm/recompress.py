"""Recompression of word sequences: rounds that replace runs of one symbol, and
then neighbouring pairs, by new symbols.

A new symbol's name is a hash of what it replaces, so equal runs and pairs get
equal names in every document and on every executor, and a round needs no exchange
to agree on names. In each round a hash bit sorts symbols into left and right ones;
a left symbol joins a right one that follows it. Each symbol carries the interval
of words on which its making depended. Where a window of words holds that whole
interval, every other place with the same words has the same symbol.
"""

from __future__ import annotations

import numpy as np

from . import textvec

_A, _B, _C = (np.uint64(x) for x in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5))


class Level:
    """Symbols of one round: name, words [start, end), dependence [low, high)."""

    def __init__(self, name, start, end, low, high, wall):
        self.name, self.start, self.end, self.low, self.high, self.wall = name, start, end, low, high, wall

    def take(self, at):
        return Level(*(x[at] for x in (self.name, self.start, self.end, self.low, self.high, self.wall)))


def words_level(hashes: np.ndarray, first: np.ndarray) -> Level:
    """The words of several texts, with a wall that nothing crosses before each.
    Places are counted with the walls: text t's words begin at first[t] + t + 1."""
    n, texts = len(hashes), len(first) - 1
    walls = np.zeros(n + texts + 1, bool)
    walls[first[:-1] + np.arange(texts)] = True
    walls[-1] = True
    name = np.zeros(len(walls), np.uint64)
    name[~walls] = hashes
    name[walls] = np.arange(1, texts + 2, dtype=np.uint64)
    at = np.arange(len(walls), dtype=np.int32)
    return Level(name, at, at + 1, at.copy(), at + 1, walls)


def runs(x: Level, cap: int, salt: int) -> Level:
    """Replaces maximal runs of one symbol, of cap words at most, by one symbol.
    Every symbol looks at both neighbours here, and those of a run at both ends of
    it. low and high never fall from one symbol to the next."""
    n = len(x.name)
    low, high = x.low.copy(), x.high.copy()
    low[1:], high[:-1] = x.low[:-1], x.high[1:]
    same = np.zeros(n + 1, bool)  # same[i]: i - 1 and i are one run
    same[1:n] = (x.name[1:] == x.name[:-1]) & ~x.wall[1:] & ~x.wall[:-1]
    if not same.any():
        return Level(x.name, x.start, x.end, low, high, x.wall)
    at = np.flatnonzero(~same[:-1] & same[1:])
    last = np.flatnonzero(same[:-1] & ~same[1:])
    count = last - at + 1
    inside = np.repeat(at - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    low[inside], high[inside] = np.repeat(x.low[at - 1], count), np.repeat(x.high[last + 1], count)
    merge = x.end[last] - x.start[at] <= cap
    gone = same[:-1].copy()
    gone[inside] &= np.repeat(merge, count)
    name, end, m = x.name.copy(), x.end.copy(), at[merge]
    name[m] = textvec.mix(x.name[m] * _A + count[merge].astype(np.uint64) * _B + np.uint64(salt)) | np.uint64(1)
    end[m] = x.end[last[merge]]
    return Level(name, x.start, end, low, high, x.wall).take(~gone)


def pairs(x: Level, cap: int, salt: int) -> Level:
    """Joins each left symbol with a right one after it, up to cap words."""
    n = len(x.name)
    side = (textvec.mix(x.name ^ np.uint64(salt)) >> np.uint64(63)).astype(bool)  # True: right
    fits = np.zeros(n, bool)
    fits[:-1] = ~side[:-1] & side[1:] & ~x.wall[:-1] & ~x.wall[1:] & (x.end[1:] - x.start[:-1] <= cap)
    second = np.zeros(n, bool)
    second[1:] = fits[:-1]
    # a left symbol looked at the one after it, a right one at the one before it
    low, high = x.low.copy(), x.high.copy()
    left, right = ~side, side
    high[:-1] = np.where(left[:-1], np.maximum(high[:-1], x.high[1:]), high[:-1])
    low[1:] = np.where(right[1:], np.minimum(low[1:], x.low[:-1]), low[1:])
    a = np.flatnonzero(fits)
    low[a], high[a] = np.minimum(x.low[a], x.low[a + 1]), np.maximum(x.high[a], x.high[a + 1])
    name, end = x.name.copy(), x.end.copy()
    name[a] = textvec.mix(x.name[a] * _A + x.name[a + 1] * _C + np.uint64(salt)) | np.uint64(1)
    end[a] = x.end[a + 1]
    return Level(name, x.start, end, low, high, x.wall).take(~second)


def parse(hashes: np.ndarray, first: np.ndarray, rounds: int, cap: int, run_every: int = 3) -> list[Level]:
    """The levels of all rounds; every run_every-th round, from the first on, also
    replaces runs. (Left out in a round, runs stay as they are: equal symbols are
    never joined as a pair.)"""
    levels = [words_level(hashes, first)]
    for r in range(rounds):
        x = levels[-1] if r % run_every else runs(levels[-1], cap, 2 * r)
        levels.append(pairs(x, cap, 0x9E37 * (2 * r + 1)))
    return levels


def anchors(levels: list[Level], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, low, high) of symbols that windows of width words are looked up by:
    for each window, the highest round with a symbol whose dependence it holds;
    windows without one there use the next lower round, at last single words."""
    n = len(levels[0].name)
    inside = np.concatenate([[0], np.cumsum(levels[0].wall)])
    need = np.zeros(n, bool)  # windows, by their first place, without an anchor yet
    if n > width:
        need[: n - width + 1] = inside[width:] == inside[: n - width + 1]
    out = []
    for level, x in reversed(list(enumerate(levels))):
        if not need.any():
            break
        ok = (x.high - x.low <= width) & ~x.wall
        lows, highs = x.low[ok], x.high[ok]
        first = np.maximum(highs - width, 0)
        before = np.concatenate([[0], np.cumsum(need)])
        use = before[np.minimum(lows + 1, n)] > before[first]
        names = x.name[ok][use]
        lows, highs, first = lows[use], highs[use], first[use]
        out.append((names ^ (np.uint64(level) << np.uint64(1)), lows, highs))
        marks = np.bincount(first, minlength=n + 1) - np.bincount(np.minimum(lows + 1, n), minlength=n + 1)
        need &= ~(np.cumsum(marks)[:n] > 0)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
