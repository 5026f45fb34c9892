"""Grouping the candidates of each context by the similarity of their vectors.

The epsilon edges of the vocabulary are found once, in blocks, each pair of
which is one product of matrices. Components are then found inside one row per
context (at most 100 candidates) by built-in functions. Iterative methods run
over batches of contexts in Arrow, where tokens look their vectors up. Every
method adds cluster_id, the lowest token of the cluster, to rows (ctx_id,
token_id, rank, ...).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions import vectors
from pairlens.operators.logits import ctx
from pairlens.plans.durable import cut, small_side

#: Defaults of the density method.
EPSILON, MIN_SAMPLES = 0.3, 2
#: Vectors of a block of the vocabulary: each pair of blocks is compared in one place, all pairs in parallel.
BLOCK_VECTORS = 1_024
#: Numbers that a vocabulary's vectors may have to be broadcast: 32 MB.
SMALL_VALUES = 4_000_000


def _matrix(vectors_: list[list[float]], width: int) -> np.ndarray:
    """Rows of norm 1; shorter vectors are filled with zeros, and zero vectors stay."""
    out = np.zeros((len(vectors_), width))
    for i, v in enumerate(vectors_):
        out[i, : len(v)] = v
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), vectors.TINY)


def _near(epsilon: float):
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                one = one.as_py()
                # a block with itself comes without the other
                other = two.as_py() if two.is_valid else one
                width = max(len(x["vec"]) for x in (*one, *other))
                distance = 1 - _matrix([x["vec"] for x in one], width) @ _matrix([x["vec"] for x in other], width).T
                i, j = np.nonzero(distance <= epsilon)
                if not two.is_valid:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    left, right = np.array([x["token_id"] for x in one], dtype=np.int32)[i], np.array([x["token_id"] for x in other], dtype=np.int32)[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(distance[i, j])], schema=schema)

    return run


def epsilon_edges(embeddings: DataFrame, epsilon: float, block: int = BLOCK_VECTORS) -> DataFrame:
    """a < b and their cosine distance, where it is at most ``epsilon``.

    All pairs of vectors are compared, as the definition asks, in pairs of
    blocks of about ``block`` vectors: a vector goes to as many places as there
    are blocks, none is sent everywhere. Null vectors are left out.
    """
    v = cut(embeddings.where(F.col("vec").isNotNull()).select(F.col("token_id").cast("int").alias("token_id"), vectors.as_double("vec").alias("vec")))
    blocks = max(1, -(-v.count() // block))
    packed = v.groupBy(F.pmod(F.xxhash64("token_id"), F.lit(blocks)).cast("int").alias("_block")).agg(F.collect_list(F.struct("token_id", "vec")).alias("_members"))
    spread = packed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("_block", "_members", F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"))
    met = spread.groupBy("_lo", "_hi").agg(F.max_by("_members", -F.col("_block")).alias("one"), F.max(F.when(F.col("_block") == F.col("_hi"), F.struct("_block", "_members"))).alias("_x"), F.count("*").alias("_n"))
    # a pair whose second block is empty has one member row, as a block with itself
    pairs = met.where((F.col("_n") == 2) | (F.col("_lo") == F.col("_hi"))).select("one", F.when(F.col("_lo") != F.col("_hi"), F.col("_x._members")).alias("two"))
    return pairs.mapInArrow(_near(epsilon), "a int, b int, distance double")


def context_edges(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """ctx_id, a, b: the edges between candidates of the same context."""
    left = candidates.select("ctx_id", F.col("token_id").alias("a")).join(edges.select("a", "b"), "a")
    return left.join(candidates.select("ctx_id", F.col("token_id").alias("b")), ["ctx_id", "b"]).select("ctx_id", "a", "b")


def components(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds cluster_id: connected components within each context.

    With up to two samples per neighbourhood this is the density method: noise
    is a cluster of its own. A token brings its neighbours along (one join with
    the vocabulary's edges, broadcast only if they are small); then a context's
    candidates meet in one row, and each edge between two of them gives the
    larger of their labels the smaller one's value. Rows stay partitioned by
    context if the edges, which are written and counted, are few enough to be
    broadcast; else they are joined by token.
    """
    kept = [c for c in candidates.columns if c not in ("ctx_id", "token_id", "cluster_id")]
    near = small_side(cut(edges.groupBy(F.col("a").alias("token_id")).agg(F.collect_list(F.col("b").cast("int")).alias("_near"))))
    rows = candidates.withColumn("token_id", F.col("token_id").cast("int")).join(near, "token_id", "left")
    met = rows.groupBy("ctx_id").agg(F.array_sort(F.collect_list(F.struct("token_id", *kept, "_near"))).alias("c"))
    met = met.withColumn("t", F.transform("c", lambda x: x["token_id"]))
    links = F.flatten(F.transform("c", lambda x: F.transform(F.filter(F.coalesce(x["_near"], F.array().cast("array<int>")), lambda b: F.array_contains(F.col("t"), b)), lambda b: F.struct(x["token_id"].alias("a"), b.alias("b")))))
    at = lambda labels, token: F.element_at(labels, F.array_position(F.col("t"), token).cast("int"))

    def joined(labels: Column, edge: Column) -> Column:
        x, y = at(labels, edge["a"]), at(labels, edge["b"])
        return F.when(x == y, labels).otherwise(F.transform(labels, lambda v: F.when(v == F.greatest(x, y), F.least(x, y)).otherwise(v)))

    labelled = met.select("ctx_id", F.explode(F.arrays_zip("c", F.aggregate(links, F.col("t"), joined).alias("l"))).alias("x"))
    return labelled.select("ctx_id", "x.c.token_id", *[f"x.c.{k}" for k in kept], F.col("x.l").alias("cluster_id"))


def core_counts(candidates: DataFrame, edges: DataFrame, min_samples: int) -> DataFrame:
    """ctx_id, token_id, neighbours (itself included), is_core."""
    links = context_edges(candidates, edges)
    both = links.select("ctx_id", F.col("a").alias("token_id")).unionByName(links.select("ctx_id", F.col("b").alias("token_id")))
    counted = both.groupBy("ctx_id", "token_id").agg(F.count("*").alias("_n"))
    rows = candidates.select("ctx_id", "token_id").join(counted, ["ctx_id", "token_id"], "left")
    return rows.select("ctx_id", "token_id", (F.coalesce("_n", F.lit(0)) + 1).alias("neighbours")).withColumn("is_core", F.col("neighbours") >= min_samples)


def single(candidates: DataFrame) -> DataFrame:
    """Adds cluster_id: all candidates of a context in one cluster."""
    return candidates.withColumn("cluster_id", F.min("token_id").over(ctx()))


def adaptive_k(n: Column, configured: int) -> Column:
    """Clusters for n candidates: 2 up to 4 of them, about the root up to 50, a third beyond, 16 and ``configured`` at most."""
    grown = F.when(n <= 4, 2).when(n <= 50, F.greatest(F.lit(2), F.floor(F.sqrt(n)).cast("int"))).otherwise(F.least(F.lit(16), F.floor(n / 3).cast("int")))
    return F.least(grown, F.lit(configured), n.cast("int"))


def k_for(n: int, configured: int) -> int:
    grown = 2 if n <= 4 else max(2, int(n**0.5)) if n <= 50 else min(16, n // 3)
    return min(grown, configured, n)


def spherical_kmeans(points: np.ndarray, k: int, seed: int = 42, rounds: int = 100) -> np.ndarray:
    """Labels by cosine distance; starts from k points drawn with ``seed``; empty clusters keep their centre."""
    n = len(points)
    if n <= k or k < 1:
        return np.arange(n)
    centres = points[np.random.RandomState(seed).choice(n, k, replace=False)].copy()
    labels = np.full(n, -1)
    for _ in range(rounds):
        new = (points @ centres.T).argmax(1)
        if (new == labels).all():
            break
        labels = new
        for c in np.unique(labels):
            mean = points[labels == c].mean(0)
            size = np.linalg.norm(mean)
            if size > 0:
                centres[c] = mean / size
    return labels


def euclidean_kmeans(points: np.ndarray, k: int, seed: int = 42, rounds: int = 10) -> np.ndarray:
    """Labels by Euclidean distance after a fixed number of rounds from one seeded start; empty clusters keep their centre."""
    n = len(points)
    if n <= k or k < 1:
        return np.arange(n)
    centres = points[np.random.RandomState(seed).permutation(n)[:k]].copy()
    for _ in range(rounds):
        labels = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        for c in np.unique(labels):
            centres[c] = points[labels == c].mean(0)
    return labels


def agglomerative(points: np.ndarray, k: int, linkage: str = "average", furthest: float = np.inf) -> np.ndarray:
    """Labels after merging the two nearest clusters until k are left or none are within ``furthest``; nearest by linkage, the first pair on ties.

    Distances are cosine, for ``ward`` squared Euclidean; after a merge they
    are updated by the Lance-Williams rule of the linkage.
    """
    n = len(points)
    if linkage not in ("average", "complete", "single", "ward"):
        raise ValueError(f"unknown linkage {linkage}")
    d = ((points[:, None] - points[None]) ** 2).sum(-1) if linkage == "ward" else 1 - points @ points.T
    d = d.astype(float)
    np.fill_diagonal(d, np.inf)
    size, labels, alive = np.ones(n), np.arange(n), np.ones(n, dtype=bool)
    for _ in range(n - min(k, n)):
        i, j = divmod(int(d.argmin()), n)
        if d[i, j] > furthest:
            break
        i, j = min(i, j), max(i, j)
        a, b, between = d[i].copy(), d[j].copy(), d[i, j]
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.maximum(a, b)
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        else:
            new = ((size[i] + size) * a + (size[j] + size) * b - size * between) / (size[i] + size[j] + size)
        new[~alive] = np.inf
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        labels[labels == labels[j]] = labels[i]
    return labels


def density(points: np.ndarray, epsilon: float, min_samples: int) -> np.ndarray:
    """Labels of the density method for any min_samples.

    Core points in order start clusters that grow through core points; a border
    point goes to the first cluster that reaches it; noise gets labels of its
    own after all others.
    """
    n = len(points)
    near = 1 - points @ points.T <= epsilon
    np.fill_diagonal(near, True)
    core = near.sum(1) >= min_samples
    labels, next_label = np.full(n, -1), 0
    for start in range(n):
        if labels[start] >= 0 or not core[start]:
            continue
        labels[start], queue = next_label, [start]
        while queue:
            at = queue.pop()
            if core[at]:
                for other in np.flatnonzero(near[at] & (labels < 0)):
                    labels[other] = next_label
                    queue.append(int(other))
        next_label += 1
    noise = labels < 0
    labels[noise] = next_label + np.arange(noise.sum())
    return labels


def _looked_up(embeddings: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Tokens in order and their vectors, if these are at most ``SMALL_VALUES`` numbers."""
    vec = cut(embeddings.where(F.col("vec").isNotNull()).select(F.col("token_id").cast("int").alias("token_id"), vectors.as_double("vec").alias("vec")))
    n, width = vec.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    if n * max(width, 1) > SMALL_VALUES:
        return None
    rows = sorted(vec.collect(), key=lambda r: r["token_id"])
    points = np.zeros((len(rows), max(width, 1)))
    for i, r in enumerate(rows):
        points[i, : len(r["vec"])] = np.nan_to_num(np.array(r["vec"], dtype=float))
    return np.array([r["token_id"] for r in rows], dtype=np.int64), points


def _points(members: pa.ListArray, known: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the contexts, token ids and vectors of a batch; a missing vector is zero."""
    flat = members.flatten()
    ids = flat.field("token_id").to_numpy(zero_copy_only=False)
    offsets = members.offsets.to_numpy()
    if known is not None:
        tokens, rows = known
        points = np.zeros((len(ids), rows.shape[1]))
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, ids), len(tokens) - 1)
            there = tokens[at] == ids
            points[there] = rows[at[there]]
        return offsets - offsets[0], ids, points
    vec = flat.field("vec")
    sizes = np.diff(vec.offsets.to_numpy()) if len(vec) else np.zeros(0, dtype=int)
    sizes = np.where(vec.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    width = int(sizes.max()) if len(sizes) and sizes.max() else 1
    points, values = np.zeros((len(ids), width)), vec.flatten().to_numpy(zero_copy_only=False)
    points[np.arange(width)[None] < sizes[:, None]] = np.nan_to_num(values)
    return offsets - offsets[0], ids, points


def per_context_each(candidates: DataFrame, embeddings: DataFrame, labels: Callable[[np.ndarray], dict[str, np.ndarray]], normalize: bool = True) -> DataFrame:
    """Adds config and cluster_id: each row once for each entry of ``labels(points)``, a function of a context's vectors in the order of their rank.

    One row per context holds its candidates, by their tokens alone; a batch of
    contexts goes through Python at once, where the tokens find their vectors in
    a broadcast array, and what else a candidate has goes along, so nothing is
    joined afterwards. Vectors of more than ``SMALL_VALUES`` numbers are joined
    to the candidates instead. A candidate without a vector counts as a zero
    vector.
    """
    kept = [c for c in candidates.columns if c not in ("ctx_id", "token_id", "cluster_id", "config")]
    known = _looked_up(embeddings)
    rows = candidates.withColumn("token_id", F.col("token_id").cast("int"))
    if known is None:
        rows = rows.join(embeddings.select("token_id", vectors.as_double("vec").alias("vec")), "token_id", "left")
    sent = rows.sparkSession.sparkContext.broadcast(known)
    met = rows.groupBy("ctx_id").agg(F.array_sort(F.collect_list(F.struct("rank", "token_id", *[k for k in kept if k != "rank"], *(["vec"] if known is None else [])))).alias("c"))
    schema = T.StructType([candidates.schema["ctx_id"], T.StructField("token_id", T.IntegerType()), *[candidates.schema[k] for k in kept], T.StructField("config", T.StringType()), T.StructField("cluster_id", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, ids, points = _points(batch.column(1), sent.value)
            if normalize:
                points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), vectors.TINY)
            clusters: dict[str, np.ndarray] = {}
            for a, b in zip(offsets[:-1], offsets[1:]):
                for name, found in labels(points[a:b]).items():
                    mine = clusters.setdefault(name, np.empty(len(ids), dtype=np.int32))[a:b]
                    for c in np.unique(found):
                        mine[found == c] = ids[a:b][found == c].min()
            flat = batch.column(1).flatten()
            owner = batch.column(0).take(pa.array(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))))
            others = [flat.field(k) for k in kept]
            for name, found in clusters.items():
                yield pa.RecordBatch.from_arrays([owner, flat.field("token_id"), *others, pa.array([name] * len(ids)), pa.array(found)], names=schema.names)

    return met.mapInArrow(run, schema)


def per_context(candidates: DataFrame, embeddings: DataFrame, labels: Callable[[np.ndarray], np.ndarray], normalize: bool = True) -> DataFrame:
    """Adds cluster_id by ``labels(points)``, see ``per_context_each``."""
    return per_context_each(candidates, embeddings, lambda x: {"": labels(x)}, normalize).drop("config")


def kmeans(candidates: DataFrame, embeddings: DataFrame, configured: int = 8) -> DataFrame:
    return per_context(candidates, embeddings, lambda x: spherical_kmeans(x, k_for(len(x), configured)))


def hierarchical(candidates: DataFrame, embeddings: DataFrame, k: int = 8, linkage: str = "average") -> DataFrame:
    return per_context(candidates, embeddings, lambda x: agglomerative(x, min(k, len(x)), linkage))


def dbscan(candidates: DataFrame, embeddings: DataFrame, epsilon: float = EPSILON, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Components where that is the same, else the general method."""
    if min_samples <= 2:
        return components(candidates, epsilon_edges(embeddings, epsilon))
    return per_context(candidates, embeddings, lambda x: density(x, epsilon, min_samples))


#: Methods of one's own by name: functions of a context's points and the spec that give labels.
CUSTOM: dict[str, Callable] = {}


def register(name: str, labels: Callable) -> None:
    """Makes a method known under a new name; ``labels(points, spec)`` gets the vectors of a context in the order of their rank."""
    if name in CUSTOM or name in ("dbscan", "kmeans", "hierarchical", "single", "euclidean"):
        raise ValueError(f"method {name} is known already")
    CUSTOM[name] = labels
