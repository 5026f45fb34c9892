"""Filling fixed-capacity containers: bounded-space online best-fit.

Items come one after another; a fixed number of containers is open, kept in a
bitset keyed by free space. An item goes into the open container that it fills
best; if none has room, a new one is opened, and if too many are then open, the
fullest closes. Items larger than the capacity are split into full pieces and a
rest; no other item is split. Lanes of about equal size are filled side by
side: how many there are follows the tokens, not the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.tokens import sized
from pairlens.plans.durable import SMALL_BYTES, SMALL_ROWS, cut, is_small

#: Containers open at once, in each lane.
OPEN = 64
#: Tokens of a lane. A lane leaves at most OPEN containers unfinished, under 3 % of its tokens for capacities up to 1,024.
LANE_TOKENS = 2_000_000

_SCHEMA = pa.schema([("container_id", pa.string()), ("bin_no", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("pieces", pa.int32()), ("first_token", pa.int64()), ("tokens", pa.int64())])


class BestFit:
    """Open containers by free space: bit f of ``mask`` is set if one with f free is open."""

    def __init__(self, capacity: int, limit: int = OPEN) -> None:
        self.capacity, self.limit = capacity, limit
        self.mask, self.by_free, self.open, self.made = 0, {}, 0, 0

    def _put(self, free: int, number: int) -> None:
        self.by_free.setdefault(free, []).append(number)
        self.mask |= 1 << free

    def _take(self, free: int) -> int:
        numbers = self.by_free[free]
        number = numbers.pop()
        if not numbers:
            del self.by_free[free]
            self.mask ^= 1 << free
        return number

    def place(self, size: int) -> int:
        """The number of the container that takes an item of ``size`` <= capacity."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
            self.open += 1
        if free == size:
            self.open -= 1
        else:
            self._put(free - size, number)
            if self.open > self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.open -= 1
        return number


def _fill(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fit = None, None
        for batch in batches:
            rows: list[tuple] = []
            for container, capacity, lane, doc, tokens in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (container, capacity, lane) != key:
                    key, fit = (container, capacity, lane), BestFit(capacity, limit)
                base, pieces = lane << 40, max(1, -(-tokens // capacity))
                for i in range(pieces):
                    size = min(capacity, tokens - i * capacity)
                    rows.append((container, base + fit.place(size), doc, i, pieces, i * capacity, size))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return run


def pack(documents: DataFrame, specs: DataFrame, open_bins: int = OPEN, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """One row per document, or piece of one, and kind of container.

    Columns: container_id, bin_no, doc_id, piece_no, pieces, first_token,
    tokens. A document without tokens (null, empty or blank text) takes no room
    and stands in some container, so that each is in the result. Kinds without
    an id or a positive capacity are left out; a repeated doc_id or kind counts
    once; empty tables give no row; other columns are ignored. The order of
    items is that of a hash of doc_id, so that the result is the same each
    time. Each kind goes to each lane, where it meets the lane's items, so
    there may be any number of kinds.
    """
    items = cut(sized(documents))
    total = items.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    lanes = int(total // lane_tokens) + 1
    order = F.xxhash64("doc_id")
    laned = items.select("doc_id", "tokens", F.pmod(order, F.lit(lanes)).alias("lane"), order.alias("h"))
    kinds = cut(specs.where("container_id IS NOT NULL AND capacity_tokens > 0").groupBy("container_id").agg(F.max("capacity_tokens").cast("long").alias("capacity")))
    each = kinds.select("container_id", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))
    side = F.broadcast(each) if is_small(kinds, SMALL_ROWS // lanes, SMALL_BYTES // lanes) else each
    rows = laned.join(side, "lane").select("container_id", "capacity", "lane", "doc_id", "tokens", "h")
    together = rows.repartition("container_id", "lane").sortWithinPartitions("container_id", "lane", "h", "doc_id").drop("h")
    return together.mapInArrow(_fill(open_bins), "container_id string, bin_no long, doc_id long, piece_no int, pieces int, first_token long, tokens long")


def oversize(placed: DataFrame) -> DataFrame:
    """container_id and doc_id of the documents that had to be split."""
    return placed.where("pieces > 1 AND piece_no = 0").select("container_id", "doc_id")


def bins(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per container: its documents, tokens and free tokens."""
    filled = placed.groupBy("container_id", "bin_no").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return filled.join(specs.groupBy("container_id").agg(F.max("capacity_tokens").alias("capacity")), "container_id").withColumn("free", F.col("capacity") - F.col("tokens"))


def accounts(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per kind of container what must hold: documents and tokens placed, containers that are overfull, documents that were split though they fit, and pieces that don't follow one another (all three 0)."""
    size = specs.groupBy("container_id").agg(F.max("capacity_tokens").alias("capacity"))
    over = bins(placed, specs).groupBy("container_id").agg(F.count_if(F.col("free") < 0).alias("overfull"))
    documents = placed.groupBy("container_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.countDistinct("piece_no").alias("numbers"), F.max("pieces").alias("pieces")).join(F.broadcast(size) if is_small(size) else size, "container_id")
    found = documents.groupBy("container_id").agg(
        F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("split_in_vain"),
        F.count_if((F.col("rows") != F.col("pieces")) | (F.col("numbers") != F.col("pieces"))).alias("broken"))
    return found.join(over, "container_id").select("container_id", "documents", "tokens", "overfull", "split_in_vain", "broken")
