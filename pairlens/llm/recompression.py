"""Recompression of texts: equal stretches get the same symbols, whatever stands around them.

Rounds name runs and pairs of neighbouring symbols; the names are hashes of
their parts, so that all texts, in any partition, share one naming without
exchanging it. Which neighbours join depends on the two symbols (a hash bit
puts each into the left or the right class) and on a cap of their length, not
on a position, so two copies of a stretch can only differ near its ends: a run
decides within ``cap`` characters, a pair within ``cap - 1``. Past that margin
their symbols are equal at every level.

The last round names, from each symbol on, the shortest sequence of symbols of
at least ``width`` characters: the high-level symbols. Of those that start
within ``reach`` characters of one another the one with the least name is kept.
With the caps 2, 4, 8 the margin is 25 and symbols have up to 8 characters, so
a common stretch of ``least`` characters keeps a common high-level symbol as
long as width + reach <= least - 2 * 25 - 13, which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CAPS = (2, 4, 8)
#: Characters taken at once; longer texts are cut into pieces that overlap by ``least``, which loses no common stretch.
PIECE = 200_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x27D4EB2F165667C5
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def margin(caps: Sequence[int] = CAPS) -> int:
    """Characters at either end of a common stretch where symbols may differ."""
    return sum(2 * c - 1 for c in caps)


def widths(least: int, caps: Sequence[int] = CAPS) -> tuple[int, int]:
    """width and reach for common stretches of ``least`` characters: two thirds and one third of what the margins leave."""
    room = least - 2 * margin(caps) - 2 * max(caps) + 3
    if room < 24:
        raise ValueError(f"common stretches of {least} characters are too short for the caps {tuple(caps)}")
    reach = room // 3
    return room - reach, reach


def _runs(names: np.ndarray, at: np.ndarray, end: np.ndarray, piece: np.ndarray, cap: int):
    """Joins each maximal run of one symbol that is no longer than ``cap``."""
    again = np.flatnonzero((names[1:] == names[:-1]) & (piece[1:] == piece[:-1]))
    if not len(again):
        return names, at, end, piece
    cuts = np.flatnonzero(np.diff(again) != 1)
    first, last = again[np.r_[0, cuts + 1]], again[np.r_[cuts, len(again) - 1]] + 1
    join = end[last] - at[first] <= cap
    drop = (again + 1)[np.repeat(join, last - first)]
    first, last = first[join], last[join]
    names, end = names.copy(), end.copy()
    names[first] = _mix(names[first] + (last - first + 1).astype(np.uint64) * _B)
    end[first] = end[last]
    keep = np.ones(len(names), dtype=bool)
    keep[drop] = False
    return names[keep], at[keep], end[keep], piece[keep]


def _pairs(names: np.ndarray, at: np.ndarray, end: np.ndarray, piece: np.ndarray, cap: int, turn: int):
    """Joins a left symbol and a right one after it, where both have no more than ``cap`` characters."""
    right = (_mix(names + np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
    join = ~right[:-1] & right[1:] & (piece[1:] == piece[:-1]) & (end[1:] - at[:-1] <= cap)
    left = np.flatnonzero(join)
    names, end = names.copy(), end.copy()
    names[left] = _mix(names[left] * _A + _mix(names[left + 1]))
    end[left] = end[left + 1]
    keep = np.ones(len(names), dtype=bool)
    keep[left + 1] = False
    return names[keep], at[keep], end[keep], piece[keep]


def symbols(codes: np.ndarray, piece: np.ndarray, caps: Sequence[int] = CAPS):
    """Names, first and last positions of the symbols after all rounds; ``piece`` tells where a text begins."""
    names, at, end = _mix(codes.astype(np.uint64) + _A), np.arange(len(codes)), np.arange(len(codes)) + 1
    for turn, cap in enumerate(caps):
        names, at, end, piece = _runs(names, at, end, piece, cap)
        names, at, end, piece = _pairs(names, at, end, piece, cap, turn)
    return names, at, end, piece


def _least_in_reach(values: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """For each symbol the index of the least value among those that start within ``reach``, the first on ties."""
    stop = np.searchsorted(at, at + reach, side="left")
    wide = stop - np.arange(len(at))
    out = np.arange(len(values))
    level, size = np.arange(len(values)), 1  # of each symbol the index of the least among it and the size - 1 next ones
    while True:
        mine = np.flatnonzero((wide >= size) & (wide < 2 * size))
        left, right = level[mine], level[stop[mine] - size]
        out[mine] = np.where(values[right] < values[left], right, left)
        if 2 * size > wide.max(initial=0):
            return out
        left, right = level[:-size], level[size:]
        level = np.where(values[right] < values[left], right, left)
        size *= 2


def anchors(texts: Sequence[str], least: int, caps: Sequence[int] = CAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept high-level symbols of some texts: the text's index, the position of the symbol's first character, its name."""
    width, reach = widths(least, caps)
    raw = [t.encode("utf-32-le") for t in texts]
    sizes = np.array([len(r) // 4 for r in raw])
    codes = np.frombuffer(b"".join(raw), dtype="<u4")
    starts = np.r_[0, np.cumsum(sizes)]
    names, at, _, piece = symbols(codes, np.repeat(np.arange(len(sizes)), sizes), caps)
    powers = np.full(len(names) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = np.r_[np.uint64(0), np.add.accumulate(names * powers[:-1])]
    inverse = np.full(len(names) + 1, _INVERSE, dtype=np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    last = starts[piece + 1]
    whole = at + width <= last
    stop = np.searchsorted(at, at + width, side="left")
    named = _mix((total[stop] - total[:-1]) * inverse[:-1])
    named[~whole] = np.iinfo(np.uint64).max
    index = _least_in_reach(named, at, reach)
    full = at + width + reach <= last
    kept = np.unique(index[full])
    kept = kept[whole[kept]]
    return piece[kept], (at[kept] - starts[piece[kept]]), named[kept].view(np.int64)


def pieces(text: str, least: int, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """Offsets and pieces of a text: itself, or overlapping pieces if it is very long."""
    if len(text) <= size:
        yield 0, text
        return
    for i in range(0, len(text) - least, size - least):
        yield i, text[i : i + size]
