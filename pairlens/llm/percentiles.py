"""Percentiles per group over very many values, by mergeable sketches.

Values go through three steps, none of which holds a group: a sketch per group
in each partition (so a hot group is pre-aggregated where it lies), a merge of
a partition's sketches by group and salt, and a last merge of the salts. Days,
files or other slices combine the same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.req_sketch import SECTION, ReqSketch
from pairlens.plans.durable import cut, small_side

#: Sketches of a group that one task merges first are those of this many salts.
SALTS = 16
#: Bytes of sketches that a task holds before it hands them on; later steps merge what belongs together.
HELD_BYTES = 64 << 20
#: Bytes of sketches in a batch that goes back to Spark.
BATCH_BYTES = 8 << 20
#: Parts into which a stretch of values is cut to find an exact percentile.
BINS = 1_024


def usable(value: str) -> Column:
    """Not null, finite and above 0."""
    v = F.col(value)
    return v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))


def _sketches(keys: Sequence[str], value: str, section: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, ReqSketch] = {}
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, dtype=np.int64)
            dictionaries = []
            for k in keys:
                d = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode")
                dictionaries.append(d.dictionary.to_pylist())
                code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            code, values = code[order], values[order]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(code)]):
                c, key = int(code[a]), []
                for d in reversed(dictionaries):
                    c, i = divmod(c, len(d))
                    key.append(d[i])
                mine = held.setdefault(tuple(reversed(key)), ReqSketch(section))
                size -= mine.size
                mine.add(values[a:b])
                size += mine.size
            if size > HELD_BYTES:
                yield from _emit(held.items(), keys)
                held, size = {}, 0
        yield from _emit(held.items(), keys)

    return run


def _emit(held: Iterable[tuple[tuple, ReqSketch]], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, zip(*[k for k, _ in rows])), pa.array([d for _, d in rows], pa.binary())], names=[*keys, "sketch"])

    for key, sketch in held:
        rows.append((key, sketch.dump()))
        size += len(rows[-1][1])
        if size >= BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _merged(keys: Sequence[str], in_order: bool):
    """Merges sketches by key; where they come in order, one is held at a time, else those up to ``HELD_BYTES``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, ReqSketch]]:
        held: dict[tuple, ReqSketch] = {}
        size = 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            for *key_, data in zip(*columns, batch.column(batch.schema.get_field_index("sketch")).to_pylist()):
                key, other = tuple(key_), ReqSketch.load(data)
                mine = held.get(key)
                if held and (in_order and mine is None or size > HELD_BYTES and not in_order):
                    yield from held.items()
                    held, size, mine = {}, 0, None
                if mine is None:
                    held[key] = other
                    size += other.size
                else:
                    size -= mine.size
                    size += mine.merge(other).size
        yield from held.items()

    return lambda batches: _emit(made(batches), keys)


def _schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField("sketch", T.BinaryType())])


def sketches(df: DataFrame, keys: Sequence[str], value: str, section: int = SECTION) -> DataFrame:
    """One row per group of ``keys``: its sketch of ``value``.

    Values that are null, not finite or not above 0 don't count; a group
    without any other gives no row, an empty table none. Null keys are a group
    of their own. Ties and repeated values count each time; drop redelivered
    rows before. Other columns are ignored. Keys must be strings, dates or
    integers.
    """
    rows = df.where(usable(value)).select(*keys, value)
    return merge(rows.mapInArrow(_sketches(keys, value, section), _schema(rows, keys)), keys)


def merge(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches by ``keys``, merged from any finer ones (partitions, days, files); each partition pre-merges what it holds."""
    schema = _schema(parts, keys)
    parts = parts.select(*keys, "sketch")
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition(*keys, "_salt").drop("_salt")
    once = salted.mapInArrow(_merged(keys, False), schema)
    return once.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(keys, True), schema)


def estimates(sketched: DataFrame, keys: Sequence[str], percents: Sequence[float]) -> DataFrame:
    """Per group: n, and for each percentile its value with the lower and upper end of its error interval (p50, p50_lo, p50_hi)."""
    names = [f"p{p:g}".replace(".", "_") for p in percents]
    schema = T.StructType([sketched.schema[k] for k in keys] + [T.StructField("n", T.LongType())] + [T.StructField(n + e, T.DoubleType()) for n in names for e in ("", "_lo", "_hi")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            rows = []
            for data in batch.column(batch.schema.get_field_index("sketch")).to_pylist():
                s = ReqSketch.load(data)
                at = [x for p in percents for x in (p / 100, p / 100 - s.rank_error(p / 100), p / 100 + s.rank_error(p / 100))]
                rows.append((s.count, *s.quantiles(at)))
            made = [pa.array(x) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] + [pa.array([], pa.float64())] * (3 * len(names))
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in schema])

    return sketched.mapInArrow(run, schema)


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Redelivered rows, equal in ``key`` and ``columns``, once; all of them are grouping keys, so the grouping hashes and never sorts."""
    return df.select(key, *columns).distinct()


def exact(df: DataFrame, keys: Sequence[str], value: str, bounds: DataFrame, percents: Sequence[float]) -> DataFrame:
    """Exact percentiles of the groups in ``bounds`` (``estimates`` with these percents): keys, percent, n, value.

    The value of a percentile is the smallest whose share of values at or below
    reaches it. The stretch of values that holds it, at first its error
    interval with what lies to either side, is cut into ``BINS`` parts, which
    are counted where the values lie; the part that holds it is cut again,
    until it is one value. No task gets a group's values, however many.
    """
    names = {p: f"p{p:g}".replace(".", "_") for p in percents}
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi")) for p, n in names.items()])).alias("x")
    state = bounds.select(*keys, "n", each).select(*keys, "n", "x.*", F.lit(0).cast("long").alias("below"), F.lit(True).alias("first"), F.lit(False).alias("done"))
    state = cut(state)
    values = df.where(usable(value)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_v"))
    settled = state.limit(0)
    while not state.isEmpty():
        side = small_side(state)
        near = values.join(side, [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]).where(F.col("first") | F.col("_v").between(F.col("lo"), F.col("hi")))
        width = F.col("hi") - F.col("lo")
        inside = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("_v") - F.col("lo")) / width * BINS).cast("int")))
        part = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), BINS).when(width > 0, inside).otherwise(0)
        counted = near.groupBy(*keys, "percent", "n", "below", part.alias("part")).agg(F.count("*").alias("times"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        reached = F.col("below") + F.sum("times").over(Window.partitionBy(*keys, "percent").orderBy("part"))
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("percent") / 100 - 1e-9))
        found = counted.withColumn("to", reached).where((F.col("to") >= rank) & (F.col("to") - F.col("times") < rank))
        state = cut(found.select(*keys, "n", "percent", "lo", "hi", (F.col("to") - F.col("times")).alias("below"), F.lit(False).alias("first"), (F.col("lo") == F.col("hi")).alias("done")))
        settled = settled.unionByName(state.where("done"))
        state = state.where("NOT done")
    return settled.select(*keys, "percent", "n", F.col("lo").alias("value"))


def skewed_groups(df: DataFrame, keys: Sequence[str], value: str, upper: float = 95, lower: float = 50, factor: float = 5.0, section: int = SECTION) -> DataFrame:
    """The groups of ``keys`` whose ``upper`` percentile exceeds ``factor`` times their ``lower`` one.

    The sketches' error intervals decide nearly all groups. What they leave
    open is settled by ``exact``.
    """
    hi, lo = f"p{upper:g}".replace(".", "_"), f"p{lower:g}".replace(".", "_")
    bounds = cut(estimates(sketches(df, keys, value, section), keys, (lower, upper)))
    sure = F.col(f"{hi}_lo") > factor * F.col(f"{lo}_hi")
    never = F.col(f"{hi}_hi") <= factor * F.col(f"{lo}_lo")
    found = bounds.where(sure).select(*keys)
    unsure = bounds.where(~sure & ~never)
    if unsure.isEmpty():
        return found
    of = lambda p: F.max(F.when(F.col("percent") == p, F.col("value")))
    settled = exact(df, keys, value, unsure, (lower, upper)).groupBy(*keys).agg(of(lower).alias("lo"), of(upper).alias("hi"))
    return found.unionByName(settled.where(F.col("hi") > factor * F.col("lo")).select(*keys))
