"""Windows over ordered steps: counters, moving averages, buckets, as-of matches."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.plans.durable import cut, small_side


def numbered(rows: DataFrame, by: str, order: list[str], flag: str) -> DataFrame:
    """timestep (0-based) and the running count of ``flag``."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("timestep", F.row_number().over(w) - 1).withColumn("so_far", F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def moving_average(rows: DataFrame, by: str, order: list[str], value: str, n: int = 10) -> DataFrame:
    """The mean of the last n values, once there are n."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - n, 0)
    return rows.withColumn("average", F.avg(value).over(w)).withColumn("_n", F.count("*").over(w)).where(F.col("_n") == n).drop("_n")


def buckets(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """bucket: the checkpoint, every n rows, in which a row is saved."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / n))


def every_nth(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).where(F.pmod("n", F.lit(n)) == 0)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each row of ``left`` the latest ``value`` of ``right`` with the same key and no later time; equal times count.

    Both sides go through one exchange and sort; nothing is multiplied.
    """
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, at, value, F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("_side") == 0, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(w)
    return both.withColumn("_c", carried).where("_side = 1").withColumn(value, F.col("_c.v")).drop("_side", "_c")


def reuse_distance(rows: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    """Per access the number of accesses since the last one of the same key, null at the first: a cache of that many entries would have hit."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    placed = rows.withColumn("_at", at)
    return placed.withColumn("distance", F.col("_at") - F.lag("_at").over(Window.partitionBy(by, key).orderBy("_at"))).drop("_at")


def until_stop(steps: DataFrame, stop_token: int, limit: int = 500, by: str = "sequence_id", at: str = "timestep", token: str = "token_id") -> DataFrame:
    """Recorded steps replayed as a generation: each sequence up to its first stop token (included) or ``limit`` steps."""
    w = Window.partitionBy(by).orderBy(at)
    stops = F.coalesce(F.sum((F.col(token) == stop_token).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("_stops", stops).withColumn("_n", F.row_number().over(w)).where((F.col("_stops") == 0) & (F.col("_n") <= limit)).drop("_stops", "_n")


def split_by_presence(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """``wanted`` with ``present``: whether ``have`` has its key. A null key is never present."""
    there = have.select(key).where(F.col(key).isNotNull()).distinct().withColumn("present", F.lit(True))
    return wanted.join(there, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def in_order(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Rows numbered from 0 in a total order, without all of them in one task.

    Ranges of the order are sorted side by side and written; each range begins
    where the counts of those before it end. Equal rows get any of their numbers.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.coalesce(F.sum("_count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(ranged.groupBy("_range").agg(F.count("*").alias("_count")).select("_range", before.alias("_start")))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(small_side(starts), "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")


def lru_hits(rows: DataFrame, by: str, order: list[str], key: str, capacity: int, lasting: str | None = None, seconds: float | None = None) -> DataFrame:
    """Adds hit: whether a cache of the ``capacity`` keys last used, one for each ``by``, has the key.

    With ``lasting``, a timestamp column, an entry made more than ``seconds``
    before is no hit and made anew. Rows stream through in order; what is held
    is one cache at a time. Null keys hit each other.
    """
    if capacity < 1:
        raise ValueError(f"capacity must be at least 1, not {capacity}")
    at = F.unix_micros(F.col(lasting).cast("timestamp")) if lasting else F.lit(0).cast("long")
    together = rows.withColumn("_at", at).repartition(by).sortWithinPartitions(by, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("hit", T.BooleanType())])
    lives, columns = int((seconds or 0) * 1_000_000), list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict = OrderedDict()
        owner: object = ()
        for batch in batches:
            hits = []
            for who, what, now in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (by, key, "_at"))):
                if who != owner:
                    owner, cache = who, OrderedDict()
                made = cache.get(what)
                hit = made is not None and (not lasting or now - made <= lives)
                hits.append(hit)
                if not hit:
                    cache[what] = now
                cache.move_to_end(what)
                if len(cache) > capacity:
                    cache.popitem(last=False)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, pa.bool_())], names=[*columns, "hit"])

    return together.mapInArrow(run, schema)
