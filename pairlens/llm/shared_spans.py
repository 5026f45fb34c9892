"""Long stretches that stand word for word in several documents, by recompression.

The kept high-level symbols of all documents meet by name. A name that few
documents hold gives their pairs, which are held against the texts and
extended; where many hold it, a document is known by the stretches of full
length around the symbol instead, so that only documents that really share one
meet. These form groups (a stretch and its documents), whose rows are as many
as documents and stretches; pairs are written out only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.recompression import PIECE, anchors, pieces, widths
from pairlens.plans.durable import cut, small_side

#: Characters (code points) of a stretch that counts.
LEAST = 160
#: Occurrences up to which a name gives pairs straight away; beyond, full-length stretches take its place.
FEW = 32
#: Documents of a group whose pairs with all of it are made in one place.
BLOCK = 256


def _anchor_rows(least: int):
    schema = pa.schema([("name", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def flush(held: list[tuple[int, int, str]]) -> pa.RecordBatch:
        which, pos, name = anchors([t for _, _, t in held], least)
        ids, offsets = np.array([d for d, _, _ in held]), np.array([o for _, o, _ in held])
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(ids[which]), pa.array((pos + offsets[which]).astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for offset, piece in pieces(text.as_py(), least):
                    held.append((doc, offset, piece))
                    size += len(piece)
                    if size >= PIECE:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return run


def _stretch_rows(least: int, width: int):
    """Of (doc_id, positions, text): a digest of 128 bits and the start of each stretch of ``least`` characters around a position."""
    schema = pa.schema([("stretch", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, spots, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw, n, done = text.as_py().encode("utf-32-le"), len(text.as_py()), set()
                for p in sorted(spots):
                    done.update(range(max(0, p + width - least), min(p, n - least) + 1))
                starts = sorted(done)
                for i in range(0, len(starts), 50_000):
                    some = starts[i : i + 50_000]
                    keys = [xxhash.xxh3_128_digest(raw[4 * s : 4 * (s + least)]) for s in some]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([doc] * len(some), pa.int64()), pa.array(some, pa.int32())], schema=schema)

    return run


def _extend(a: str, b: str, i: int, j: int) -> tuple[int, int]:
    """How far a and b agree to the left of i and j and, with these, to the right."""
    left, step = 0, 64
    while step:
        if step <= min(i, j) - left and a[i - left - step : i - left] == b[j - left - step : j - left]:
            left += step
            step *= 2
        else:
            step //= 2
    right, step = 0, 64
    while step:
        if step <= min(len(a) - i, len(b) - j) - right and a[i + right : i + right + step] == b[j + right : j + right + step]:
            right += step
            step *= 2
        else:
            step //= 2
    return left, right


def _verified(least: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("start_a", pa.int32()), ("start_b", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            get = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for a, b, spots, ta, tb in zip(get["a"].to_pylist(), get["b"].to_pylist(), get["spots"].to_pylist(), get["text_a"], get["text_b"]):
                ta, tb, reached = ta.as_py(), tb.as_py(), {}
                for i, j in sorted({(s["pa"], s["pb"]) for s in spots}):
                    if reached.get(i - j, -1) > i:
                        continue
                    left, right = _extend(ta, tb, i, j)
                    reached[i - j] = i + max(right, 1)
                    if left + right >= least:
                        rows.append((a, b, i - left, j - left, left + right))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, rep, n_chars, copies: each document with the smallest id that has the very same text, and how many others have it; null texts and ids left out.

    Only texts that occur twice or more are joined back to their documents.
    """
    rows = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.unhex(F.sha2("text", 256)).alias("_h"), F.length("text").alias("n_chars"))
    once = rows.groupBy("doc_id").agg(F.min(F.struct("_h", "n_chars")).alias("x")).select("doc_id", "x.*")
    written = cut(once)
    twice = cut(written.groupBy("_h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    return written.join(small_side(twice), "_h", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n_chars", (F.coalesce("n", F.lit(1)) - 1).alias("copies"))


def pairs_within(members: DataFrame, group: str) -> DataFrame:
    """a < b of each group, of rows (``group``, doc_id, n: the group's documents).

    A large group is cut into blocks, each of which meets all of the group, so
    that no task gets all of its pairs.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    one = members.select(group, F.col("doc_id").alias("a"), F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("_block"))
    two = members.select(group, F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"))
    return one.join(two, [group, "_block"]).where("a < b").select("a", "b")


class Shared:
    """The stages: ``members`` (classes of equal texts), ``spans`` of pairs, ``stretches`` of crowded names, each written once.

    Texts are read where they are needed and never exchanged, unless the
    documents that hold candidates are too many to be named by a broadcast.
    """

    def __init__(self, documents: DataFrame, least: int = LEAST, few: int = FEW) -> None:
        self.least = least
        width, _ = widths(least)
        self.members = cut(classes(documents))
        others = cut(self.members.where("doc_id <> rep").select("doc_id"))
        whole = documents.where((F.length("text") >= least) & F.col("doc_id").isNotNull()).select("doc_id", "text")
        texts = whole.join(small_side(others), "doc_id", "left_anti")
        names = cut(texts.mapInArrow(_anchor_rows(least), "name long, doc_id long, pos int"))
        met = names.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        common = cut(names.join(small_side(cut(met.select("name", (F.col("n") > few).alias("crowded")))), "name"))
        cold = common.where("NOT crowded")
        pairs = (
            cold.select("name", F.col("doc_id").alias("a"), F.col("pos").alias("pa"))
            .join(cold.select("name", F.col("doc_id").alias("b"), F.col("pos").alias("pb")), "name").where("a < b")
            .groupBy("a", "b").agg(F.collect_set(F.struct("pa", "pb")).alias("spots"))
        )
        crowded = cut(common.where("crowded").groupBy("doc_id").agg(F.collect_set("pos").alias("spots")))
        around = cut(whole.join(small_side(crowded.select("doc_id")), "doc_id", "left_semi").join(crowded, "doc_id").select("doc_id", "spots", "text").mapInArrow(_stretch_rows(least, width), "stretch binary, doc_id long, start int"))
        held = around.groupBy("stretch").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("stretch")
        self.stretches = cut(around.join(held, "stretch"))
        every = cut(pairs)
        holders = cut(every.select(F.col("a").alias("doc_id")).unionByName(every.select(F.col("b").alias("doc_id"))).distinct())
        texts = whole.join(small_side(holders), "doc_id", "left_semi")
        both = every.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        self.spans = cut(both.mapInArrow(_verified(least), "a long, b long, start_a int, start_b int, length int"))

    def groups(self) -> DataFrame:
        """group_id, doc_id, n: documents (one of each class of copies) that share a crowded stretch; n is the group's size.

        Neighbouring stretches are mostly held by the same documents; such a
        set, known by two sums of its documents' hashes, is one group.
        """
        rows = self.stretches.select("stretch", "doc_id").distinct()
        wide = F.xxhash64("doc_id").cast("decimal(20,0)")
        more = F.xxhash64("doc_id", F.lit(1)).cast("decimal(20,0)")
        sets = rows.groupBy("stretch").agg(F.count("*").alias("n"), F.sum(wide).alias("s"), F.sum(more).alias("t")).groupBy("n", "s", "t").agg(F.min("stretch").alias("stretch"))
        kept = cut(sets.select("stretch", "n", F.xxhash64("s", "t", "n").alias("group_id")))
        return rows.join(small_side(kept), "stretch").select("group_id", "doc_id", "n")

    def pairs(self) -> DataFrame:
        """doc_id_a < doc_id_b that share a stretch; copies of a text are paired too, one with another."""
        reps = self.spans.select("a", "b").unionByName(pairs_within(self.groups(), "group_id")).distinct()
        of = lambda name: self.members.select(F.col("rep").alias(f"_{name}"), F.col("doc_id").alias(f"doc_{name}"))
        between = reps.join(of("x"), reps.a == F.col("_x")).join(of("y"), F.col("b") == F.col("_y"))
        between = between.select(F.least("doc_x", "doc_y").alias("doc_id_a"), F.greatest("doc_x", "doc_y").alias("doc_id_b"))
        same = self.members.where((F.col("n_chars") >= self.least) & (F.col("copies") > 0)).select("rep", "doc_id", (F.col("copies") + 1).alias("n"))
        return between.unionByName(pairs_within(same, "rep").toDF("doc_id_a", "doc_id_b"))

    def linked(self) -> DataFrame:
        """The same links without writing out pairs: kind, group_id, doc_id.

        ``copies``: documents with the very same text of ``least`` characters
        or more, under the smallest of their ids. ``stretch``: classes, each
        by its smallest id, that share a crowded stretch. ``pair``: two classes
        that share another stretch. Rows grow with documents and shared
        stretches, however many documents share one.
        """
        copies = self.members.where((F.col("n_chars") >= self.least) & (F.col("copies") > 0)).select(F.lit("copies").alias("kind"), F.col("rep").alias("group_id"), "doc_id")
        crowded = self.groups().select(F.lit("stretch").alias("kind"), "group_id", "doc_id")
        two = self.spans.select("a", "b").distinct().select(F.lit("pair").alias("kind"), F.xxhash64("a", "b").alias("group_id"), F.explode(F.array("a", "b")).alias("doc_id"))
        return copies.unionByName(crowded).unionByName(two)

    def coverage(self) -> DataFrame:
        """One row per document with text: doc_id, n_chars, shared_chars, shared_share, class_id (the smallest id with the same text), copies."""
        spans = (
            self.spans.select(F.col("a").alias("rep"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e"))
            .unionByName(self.spans.select(F.col("b").alias("rep"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e")))
            .unionByName(self.stretches.select(F.col("doc_id").alias("rep"), F.col("start").alias("s"), (F.col("start") + self.least).alias("e")))
            .groupBy("rep", "s").agg(F.max("e").alias("e"))
        )
        before = F.max("e").over(Window.partitionBy("rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
        covered = spans.withColumn("from", F.greatest("s", F.coalesce(before, F.lit(0)))).groupBy("rep").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.col("from"))).alias("covered"))
        whole = (F.col("copies") > 0) & (F.col("n_chars") >= self.least)
        shared = F.when(whole, F.col("n_chars").cast("long")).otherwise(F.coalesce("covered", F.lit(0)).cast("long"))
        rows = self.members.join(covered, "rep", "left").withColumn("shared_chars", shared)
        return rows.select(
            "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "shared_chars",
            F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0).alias("shared_share"),
            F.col("rep").alias("class_id"), "copies",
        )


def shared_pairs(documents: DataFrame, least: int = LEAST, few: int = FEW) -> DataFrame:
    """Pairs of documents with ``least`` or more consecutive code points in common: doc_id_a < doc_id_b, each once.

    Null and shorter texts pair with none; an empty table gives no row; case
    and white space count; a repeated doc_id counts once; other columns are
    ignored. No stretch is missed: see ``recompression``.
    """
    return Shared(documents, least, few).pairs()


def shared_coverage(documents: DataFrame, least: int = LEAST, few: int = FEW) -> DataFrame:
    """For each document with text how many of its characters lie in stretches shared with others."""
    return Shared(documents, least, few).coverage()


def shared_links(documents: DataFrame, least: int = LEAST, few: int = FEW) -> DataFrame:
    """The links of ``shared_pairs`` as classes and groups, see ``Shared.linked``."""
    return Shared(documents, least, few).linked()
