"""Mixing sources to target weights: balanced sampling by the cube method.

A source whose target needs r times its tokens gives each document floor(r)
times, and once more with the probability of the fraction. The flight phase
moves these probabilities through the null space of two constraints, the
documents and the tokens of the source, until at most two of a lane are left.
The longest documents settle first, against all others of the lane at once, so
that only ordinary ones are left. Those of all lanes fly on in fewer lanes,
level by level, and the last two land by the choice whose tokens come closest to what is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.tokens import sized
from pairlens.plans.durable import cut, is_small

#: Documents of a lane of the flight.
LANE_DOCS = 50_000
#: So many of the longest documents of a lane, or an eighth of them, settle first.
LONGEST = 64
_NEAR = 1e-9
_FIELDS = "mix_id string, source string, doc_id long, tokens long, whole int, p double"


def _coin(seed: int, doc: int) -> float:
    """A number from [0, 1) that follows from seed and doc."""
    x = (doc * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) >> 11) / 9007199254740992.0


def flight_step(p: list[float], t: list[int], coin: float) -> None:
    """Moves three probabilities so that their sum and their sum of tokens stay and at least one becomes 0 or 1; on average none changes."""
    u = (float(t[2] - t[1]), float(t[0] - t[2]), float(t[1] - t[0]))
    if not any(u):
        u = (1.0, -1.0, 0.0)
    forth = min(((1 - p[i]) / u[i] if u[i] > 0 else -p[i] / u[i]) for i in range(3) if u[i])
    back = min((p[i] / u[i] if u[i] > 0 else (p[i] - 1) / u[i]) for i in range(3) if u[i])
    step = forth if coin < back / (forth + back) else -back
    for i in range(3):
        p[i] += step * u[i]
        if p[i] < _NEAR:
            p[i] = 0.0
        elif p[i] > 1 - _NEAR:
            p[i] = 1.0


def settle_longest(p: np.ndarray, t: np.ndarray, docs: np.ndarray, seed: int, most: int = LONGEST) -> np.ndarray:
    """Probabilities after the longest documents have moved to 0 or 1, each balanced by small moves of all others."""
    p = p.copy()
    for b in np.argsort(-t, kind="stable")[: min(most, len(t) // 8)]:
        for turn in range(4):
            w = p * (1 - p)
            w[b] = 0.0
            if not 0 < p[b] < 1 or np.count_nonzero(w) < 3:
                break
            m0, m1, m2 = w.sum(), (w * t).sum(), (w * t * t).sum()
            det = m0 * m2 - m1 * m1
            if det <= 1e-9 * m0 * m2:
                break
            u = -w * ((m2 - m1 * t[b]) + (m0 * t[b] - m1) * t) / det
            u[b] = 1.0
            moving = np.flatnonzero(u)
            up, down = (1 - p[moving]) / np.abs(u[moving]), p[moving] / np.abs(u[moving])
            rising = u[moving] > 0
            forth, back = np.where(rising, up, down).min(), np.where(rising, down, up).min()
            p = p + (forth if _coin(seed + turn, int(docs[b])) < back / (forth + back) else -back) * u
            p[p < _NEAR] = 0.0
            p[p > 1 - _NEAR] = 1.0
    return p


def fly(units: Iterator[tuple[int, int, int, float]], seed: int) -> Iterator[tuple[int, int, int, float]]:
    """(doc, tokens, whole, p) with each p moved to 0 or 1, but for the last two at most."""
    held: list[list] = []
    for doc, tokens, whole, p in units:
        if p <= 0 or p >= 1:
            yield doc, tokens, whole, p
            continue
        held.append([doc, tokens, whole, p])
        while len(held) == 3:
            ps = [h[3] for h in held]
            flight_step(ps, [h[1] for h in held], _coin(seed, held[2][0] ^ held[0][0] << 1))
            for h, x in zip(held, ps):
                h[3] = x
            done = [h for h in held if h[3] in (0.0, 1.0)]
            held = [h for h in held if h[3] not in (0.0, 1.0)]
            yield from map(tuple, done)
    yield from map(tuple, held)


def land(rest: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The few left over, each taken or not: the choice nearest to their expected tokens, then documents, then the first."""
    want, count = sum(r[1] * r[3] for r in rest), sum(r[3] for r in rest)
    best = min(product((0.0, 1.0), repeat=len(rest)), key=lambda c: (abs(sum(r[1] * x for r, x in zip(rest, c)) - want), abs(sum(c) - count), c))
    return [(*r[:3], x) for r, x in zip(rest, best)]


def _runner(key_columns: int, seed: int, last: bool):
    """Flight over rows sorted by their first ``key_columns`` columns; the rest is doc_id, tokens, whole, p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(key_columns + 4)))

        source, held = rows(), None
        ahead = next(source, None)
        out: list[tuple] = []
        while ahead is not None:
            key = ahead[:key_columns]

            def group() -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and ahead[:key_columns] == key:
                    yield ahead[key_columns:]
                    ahead = next(source, None)

            left, lane = [], list(group())
            if lane:
                docs, sizes = np.array([u[0] for u in lane], dtype=object), np.array([u[1] for u in lane], dtype=float)
                settled = settle_longest(np.array([u[3] for u in lane]), sizes, docs, seed)
                lane = [(*u[:3], float(x)) for u, x in zip(lane, settled)]
            for unit in fly(iter(lane), seed):
                if last and 0 < unit[3] < 1:
                    left.append(unit)
                else:
                    out.append((*key[:2], *unit))
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            out.extend((*key[:2], *u) for u in land(left))
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["mix_id", "source", "doc_id", "tokens", "whole", "p"])


class Mix:
    """``chosen``: mix_id, source, doc_id, tokens, copies. ``targets``: per mix and source what was asked for."""

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 1, lane_docs: int = LANE_DOCS) -> None:
        docs = cut(sized(documents, "source"))
        total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
        lanes = int(total["n"] // lane_docs) + 1
        # a source is pre-aggregated where it lies; a hot one is one row per partition by then
        per_source = docs.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("has_tokens"), F.count("*").alias("has_docs"))
        asked = targets.where("mix_id IS NOT NULL AND source IS NOT NULL").groupBy("mix_id", "source").agg(F.max(F.struct("weight", "max_repeats", "total_fraction")).alias("a"))
        asked = asked.select("mix_id", "source", "a.*").withColumn("target_tokens", F.col("weight") * F.col("total_fraction") * F.lit(total["t"]))
        self.targets = cut(asked.join(per_source, "source", "left").fillna(0, ["has_tokens", "has_docs"]))
        need = F.when(F.col("has_tokens") > 0, F.least(F.greatest(F.col("target_tokens") / F.col("has_tokens"), F.lit(0.0)), F.col("max_repeats").cast("double")))
        wanted = self.targets.select("mix_id", "source", F.coalesce(need, F.lit(0.0)).alias("r"))
        order = F.xxhash64("doc_id")
        # targets are few; were they many, a lane of documents would still be the unit that is exchanged
        laned = docs.withColumn("lane", F.pmod(order, F.lit(lanes)))
        asked_for = wanted.where("r > 0")
        if is_small(asked_for):
            met = laned.join(F.broadcast(asked_for), "source")
        else:
            met = laned.join(asked_for.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))), ["source", "lane"])
        rest = met.select("mix_id", "source", "lane", "doc_id", "tokens", F.floor("r").cast("int").alias("whole"), (F.col("r") - F.floor("r")).alias("p"))
        open_, every, level = F.col("p").between(1e-300, 1 - 1e-16), None, seed
        while lanes > 1 or every is None:
            # what a level of lanes leaves open, two documents of each, flies on in fewer lanes
            together = rest.repartition("mix_id", "source", "lane").sortWithinPartitions("mix_id", "source", "lane", order, "doc_id")
            flown = cut(together.mapInArrow(_runner(3, level, False), _FIELDS))
            done = flown.where(~open_)
            every = done if every is None else every.unionByName(done)
            left = flown.where(open_)
            lanes, level = int(left.count() // lane_docs) + 1, level + 1
            rest = left.select("mix_id", "source", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(lanes)).alias("lane"), "doc_id", "tokens", "whole", "p")
        last = rest.drop("lane").repartition("mix_id", "source").sortWithinPartitions("mix_id", "source", order, "doc_id")
        every = every.unionByName(last.mapInArrow(_runner(2, level, True), _FIELDS))
        self.chosen = cut(every.select("mix_id", "source", "doc_id", "tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies")).where("copies > 0"))

    def shares(self) -> DataFrame:
        """Per mix and source: weight, target_tokens, has_tokens, actual_tokens, actual_share, docs, copies, short (missed even when fully repeated)."""
        got = self.chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("docs"), F.sum("copies").alias("copies"))
        whole = self.chosen.groupBy("mix_id").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"))
        rows = self.targets.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left").fillna(0, ["actual_tokens", "docs", "copies", "mix_tokens"])
        full = F.col("actual_tokens") == F.col("max_repeats") * F.col("has_tokens")
        return rows.select(
            "mix_id", "source", "weight", "max_repeats", "target_tokens", "has_tokens", "actual_tokens",
            F.when(F.col("mix_tokens") > 0, F.col("actual_tokens") / F.col("mix_tokens")).otherwise(0.0).alias("actual_share"),
            "docs", "copies", (full & (F.col("actual_tokens") < F.col("target_tokens"))).alias("short"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 1) -> Mix:
    """A selection of ``documents`` for each mix of ``targets``.

    A repeated doc_id counts once; a document without source is in the total
    only; one without tokens may be chosen and adds nothing. Targets without
    mix or source are left out, of repeated ones the largest counts; a negative
    target counts as 0. Empty tables give no rows. Extra columns are ignored.
    """
    return Mix(documents, targets, seed)
