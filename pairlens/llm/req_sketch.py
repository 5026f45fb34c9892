"""A mergeable quantile sketch of relative-rank compactors.

Levels hold items of weight 2**level. A compactor that overflows protects its
upper half and halves a stretch of its smallest items: how long a stretch
follows the count of its compactions (each further trailing one bit adds a
section), so items near the top, whose rank from above is small, are hardly
ever compacted. The error of a rank is therefore relative to the number of
items above it: multiplicative at the extreme upper percentiles. Merging joins
levels and ors the counts. Below the first overflow the sketch is exact.
"""

from __future__ import annotations

import numpy as np

#: Items of a section: with 64 the rank error at three standard deviations is under 0.7 % of the share of items above.
SECTION = 64
SECTIONS = 3
MAGIC = 0x9E3779B97F4A7C15


class ReqSketch:
    """Levels of sorted arrays; ``count`` items seen, ``states`` compactions per level."""

    def __init__(self, section: int = SECTION) -> None:
        self.section, self.count = section, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.states: list[int] = [0]
        self.sections: list[int] = [SECTIONS]
        self.low = self.high = float("nan")

    def _capacity(self, h: int) -> int:
        return 2 * self.section * self.sections[h]

    def add(self, values: np.ndarray) -> None:
        """Takes in finite values; chunks keep a compactor within twice its capacity."""
        if not len(values):
            return
        values = np.asarray(values, dtype=float)
        self._span(values.min(), values.max())
        step = self._capacity(0)
        for i in range(0, len(values), step):
            chunk = values[i : i + step]
            self.count += len(chunk)
            self.levels[0] = np.concatenate([self.levels[0], chunk])
            self._compress()

    def _span(self, low: float, high: float) -> None:
        self.low, self.high = np.fmin(self.low, low), np.fmax(self.high, high)

    def _grow(self) -> None:
        self.levels.append(np.empty(0))
        self.states.append(0)
        self.sections.append(SECTIONS)

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) >= self._capacity(h):
                if h + 1 == len(self.levels):
                    self._grow()
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        items, state = np.sort(self.levels[h]), self.states[h]
        ones = 0
        while state >> ones & 1:
            ones += 1
        # the protected upper half; below it the sections that this count lets go, and all that overflowed
        protected = self.section * self.sections[h]
        keep_low = max(0, self.sections[h] - 1 - ones) * self.section
        free = len(items) - protected - min(keep_low, max(0, len(items) - protected - self.section))
        free -= free % 2
        # the coin is a hash of the level and count: runs give the same sketch, a pair of compactions takes both halves
        coin = (((h * 1_000_003 + (state >> 1) + 1) * MAGIC >> 40) ^ state) & 1
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[coin:free:2]])
        self.levels[h] = items[free:]
        self.states[h] = state + 1
        if self.states[h] >= 1 << (self.sections[h] - 1) and self.sections[h] < 64:
            self.sections[h] *= 2

    def merge(self, other: "ReqSketch") -> "ReqSketch":
        """Takes in another sketch of the same section size."""
        self.count += other.count
        self._span(other.low, other.high)
        while len(self.levels) < len(other.levels):
            self._grow()
        for h, items in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.states[h] |= other.states[h]
            self.sections[h] = max(self.sections[h], other.sections[h])
        self._compress()
        return self

    @property
    def size(self) -> int:
        """Bytes of the items, about."""
        return 8 * sum(map(len, self.levels)) + 200

    @property
    def exact(self) -> bool:
        return len(self.levels) == 1

    def rank_error(self, q: float, deviations: float = 3.0) -> float:
        """Half width of the interval of q, as a share of all items."""
        if self.exact:
            return 0.0
        relative = np.sqrt(0.0512 / SECTIONS) / self.section * (1 - q)
        return float(deviations * min(relative + 1.0 / self.count, 0.084 / self.section))

    def quantiles(self, qs: np.ndarray) -> np.ndarray:
        """The smallest items whose share of items at or below reaches qs; null (NaN) if empty."""
        if not self.count:
            return np.full(len(qs), np.nan)
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << h) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        ranks = np.cumsum(weights[order])
        at = np.searchsorted(ranks, np.clip(np.asarray(qs), 0, 1) * ranks[-1] - 1e-9)
        return np.clip(items[order][np.minimum(at, len(items) - 1)], self.low, self.high)

    def dump(self) -> bytes:
        """Section size, count, span, then per level its state, sections, length and items."""
        head = np.array([self.section, self.count, len(self.levels)], dtype="<i8").tobytes() + np.array([self.low, self.high], dtype="<f8").tobytes()
        meta = np.array([(s, c, len(x)) for s, c, x in zip(self.states, self.sections, self.levels)], dtype="<i8").tobytes()
        return head + meta + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> "ReqSketch":
        section, count, n = (int(x) for x in np.frombuffer(data, "<i8", 3))
        out = cls(section)
        out.count = count
        out.low, out.high = np.frombuffer(data, "<f8", 2, 24)
        meta = np.frombuffer(data, "<i8", 3 * n, 40).reshape(n, 3)
        items = np.frombuffer(data, "<f8", int(meta[:, 2].sum()), 40 + 24 * n)
        cuts = np.cumsum(meta[:, 2])[:-1]
        out.levels = [x.copy() for x in np.split(items, cuts)]
        out.states, out.sections = [int(x) for x in meta[:, 0]], [int(x) for x in meta[:, 1]]
        return out
