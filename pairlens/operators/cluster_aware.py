"""Cluster-aware selection: candidates, clusters, category, token, as one plan over all contexts."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import category, clustering
from pairlens.operators import logits as lg


@dataclass(frozen=True)
class ClusterSpec:
    """What a cluster-aware sampler does.

    method: dbscan, kmeans, hierarchical or single; category: greedy,
    confidence or information. Contexts with up to ``bypass`` candidates aren't
    clustered: their highest logit wins.
    """

    method: str = "kmeans"
    category: str = "confidence"
    clusters: int = 8
    top: int = 50
    dynamic: bool = True
    epsilon: float = clustering.EPSILON
    min_samples: int = clustering.MIN_SAMPLES
    linkage: str = "average"
    normalize: bool = True
    bypass: int = 3

    def __post_init__(self) -> None:
        if self.method not in ("dbscan", "kmeans", "hierarchical", "single", "euclidean", *clustering.CUSTOM):
            raise ValueError(f"unknown method {self.method}")
        if self.category not in category.SCORES:
            raise ValueError(f"unknown category selection {self.category}")


DEFAULT = ClusterSpec()
LIGHTWEIGHT = ClusterSpec(clusters=4, top=20)
#: Plain top-n candidates, Euclidean k-means, the heaviest category.
BATCH = ClusterSpec(method="euclidean", category="greedy", dynamic=False, bypass=0)
#: As BATCH on vectors as they are.
BOUNDED = replace(BATCH, normalize=False)


def clustered(logits: DataFrame, embeddings: DataFrame | None, spec: ClusterSpec = DEFAULT, allowed: DataFrame | None = None) -> DataFrame:
    """ctx_id, token_id, logit, rank, p (over the candidates), n, cluster_id (null where not clustered)."""
    if embeddings is None:
        raise ValueError("cluster-aware selection needs embeddings")
    cand = lg.softmax(lg.candidates(logits, allowed, spec.top, spec.dynamic)).withColumn("n", F.count("*").over(lg.ctx()))
    if spec.method == "single":
        labelled = clustering.single(cand)
    elif spec.method == "dbscan":
        labelled = clustering.dbscan(cand, embeddings, spec.epsilon, spec.min_samples)
    elif spec.method == "hierarchical":
        labelled = clustering.hierarchical(cand, embeddings, spec.clusters, spec.linkage)
    elif spec.method in clustering.CUSTOM:
        own = clustering.CUSTOM[spec.method]
        labelled = clustering.per_context(cand, embeddings, lambda x: own(x, spec), spec.normalize)
    elif spec.method == "euclidean":
        k = spec.clusters
        labelled = clustering.per_context(cand, embeddings, lambda x: clustering.euclidean_kmeans(x, k), spec.normalize)
    else:
        labelled = clustering.kmeans(cand, embeddings, spec.clusters)
    return labelled.withColumn("cluster_id", F.when(F.col("n") > spec.bypass, F.col("cluster_id")))


def select(logits: DataFrame, embeddings: DataFrame | None, spec: ClusterSpec = DEFAULT, allowed: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """ctx_id, sampler, token_id, cluster_id (null where the context wasn't clustered), and the token's ``carry`` columns.

    A context without candidates gives no row. Candidates without a vector are
    alone under ``dbscan`` and zero vectors elsewhere.
    """
    rows = clustered(logits, embeddings, spec, allowed)
    # a context that isn't clustered is one group without an id, so its highest logit wins
    chosen = category.best_cluster(category.SCORES[spec.category](category.mass(rows, *carry)))
    return chosen.select("ctx_id", F.lit("dcbs").alias("sampler"), "token_id", "cluster_id", *carry)


def history(logits: DataFrame, embeddings: DataFrame, spec: ClusterSpec = DEFAULT, allowed: DataFrame | None = None) -> DataFrame:
    """The decision of each clustered context: candidates, clusters, sizes and masses by cluster, the choice."""
    rows = clustered(logits, embeddings, spec, allowed).where(F.col("n") > spec.bypass)
    scored = category.SCORES[spec.category](category.mass(rows))
    best = F.max_by(F.struct("cluster_id", "token_id"), F.struct(F.col("score"), -F.col("cluster_id")))
    per = scored.groupBy("ctx_id").agg(
        F.sum("size").alias("candidate_count"), F.count("*").alias("num_clusters"), best.alias("b"),
        F.array_sort(F.collect_list(F.struct("cluster_id", "size", "mass"))).alias("clusters"))
    return per.select("ctx_id", "candidate_count", "num_clusters", "clusters", F.col("b.cluster_id").alias("selected_cluster"), F.col("b.token_id").alias("selected_token"))


def statistics(logits: DataFrame, spec: ClusterSpec = DEFAULT, allowed: DataFrame | None = None) -> DataFrame:
    """One row: contexts decided, those clustered, those taken by their highest logit, and candidates in all."""
    sizes = lg.candidates(logits, allowed, spec.top, spec.dynamic).groupBy("ctx_id").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("total_samples"), F.count_if(F.col("n") > spec.bypass).alias("clustering_calls"),
        F.count_if(F.col("n") <= spec.bypass).alias("bypassed"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))


def _labels(specs: dict[str, ClusterSpec]):
    """All specs' labels of one context's points; specs that ask for the same share them."""
    own = {s.method: clustering.CUSTOM[s.method] for s in specs.values() if s.method in clustering.CUSTOM}

    def of(points: np.ndarray) -> dict[str, np.ndarray]:
        made: dict[tuple, np.ndarray] = {}
        out = {}
        for name, s in specs.items():
            key = (s.method, s.epsilon, s.min_samples) if s.method == "dbscan" else (name,) if s.method in own else (s.method, s.clusters, s.linkage)
            if key not in made:
                n = len(points)
                made[key] = (
                    clustering.density(points, s.epsilon, s.min_samples) if s.method == "dbscan"
                    else clustering.agglomerative(points, min(s.clusters, n), s.linkage) if s.method == "hierarchical"
                    else clustering.euclidean_kmeans(points, s.clusters) if s.method == "euclidean"
                    else np.zeros(n, dtype=int) if s.method == "single"
                    else own[s.method](points, s) if s.method in own
                    else clustering.spherical_kmeans(points, clustering.k_for(n, s.clusters)))
            out[name] = made[key]
        return out

    return of


def sweep(logits: DataFrame, embeddings: DataFrame, specs: dict[str, ClusterSpec], allowed: DataFrame | None = None) -> DataFrame:
    """Selections of several specs, one under another, named by ``config``: config, ctx_id, token_id, cluster_id.

    Specs with the same candidates share them: a context's candidates meet
    once, and all clusterings of it are made in one place.
    """
    groups: dict[tuple, dict[str, ClusterSpec]] = {}
    for name, s in specs.items():
        groups.setdefault((s.top, s.dynamic, s.normalize, s.bypass, s.category), {})[name] = s
    out = None
    for (top, dynamic, normalize, bypass, score), mine in groups.items():
        cand = lg.softmax(lg.candidates(logits, allowed, top, dynamic)).withColumn("n", F.count("*").over(lg.ctx()))
        rows = clustering.per_context_each(cand, embeddings, _labels(mine), normalize)
        # a context of one spec is a context of its own
        keyed = rows.withColumn("ctx_id", F.struct("ctx_id", "config")).withColumn("cluster_id", F.when(F.col("n") > bypass, F.col("cluster_id")))
        chosen = category.best_cluster(category.SCORES[score](category.mass(keyed))).select("ctx_id.config", "ctx_id.ctx_id", "token_id", "cluster_id")
        out = chosen if out is None else out.unionByName(chosen)
    return out


# The search space of the clustering methods.
GRID = {
    "kmeans": {"clusters": (4, 8, 16), "top": (30, 50)},
    "dbscan": {"epsilon": (0.2, 0.3, 0.5), "min_samples": (1, 2, 3)},
    "hierarchical": {"clusters": (4, 8, 16), "linkage": ("average", "complete")},
}


def grid(space: dict[str, dict[str, tuple]] = GRID) -> dict[str, ClusterSpec]:
    """All specs of a search space by name: the product of each method's parameters."""
    out = {}
    for method, parameters in space.items():
        for values in product(*parameters.values()):
            given = dict(zip(parameters, values))
            out[" ".join([method, *(f"{k}={v}" for k, v in given.items())])] = ClusterSpec(method=method, **given)
    return out
