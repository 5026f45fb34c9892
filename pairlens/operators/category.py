"""Scoring the clusters of a context; the best one brings its likeliest token along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the confidence-aware score, tolerance of the pruning one.
SIZE_WEIGHT, ENTROPY_WEIGHT, TINY, TOLERANCE = 0.1, 0.05, 1e-8, 1e-10


def mass(clustered: DataFrame, *carry: str) -> DataFrame:
    """ctx_id, cluster_id, mass, size, token_id, the likeliest token, and its ``carry`` columns, of rows (ctx_id, token_id, cluster_id, p, logit, ...)."""
    likeliest = F.max_by(F.struct("token_id", *carry), F.struct(F.col("p"), F.col("logit"), -F.col("token_id"))).alias("x")
    return clustered.groupBy("ctx_id", "cluster_id").agg(F.sum("p").alias("mass"), F.count("*").alias("size"), likeliest).select("ctx_id", "cluster_id", "mass", "size", "x.*")


def greedy_score(masses: DataFrame) -> DataFrame:
    return masses.withColumn("score", F.col("mass"))


def confidence_score(masses: DataFrame, size_weight: float = SIZE_WEIGHT, entropy_weight: float = ENTROPY_WEIGHT) -> DataFrame:
    """Mass less a penalty for small clusters and one for its entropy term; clusters without mass never win."""
    m = F.col("mass")
    score = m - size_weight / F.col("size") - entropy_weight * (-m * F.ln(m + TINY))
    return masses.withColumn("score", F.when(m > 0, score).otherwise(F.lit(float("-inf"))))


def kl_of_removal(masses: DataFrame) -> DataFrame:
    """Adds kl: the divergence of the masses from themselves with the cluster taken out and the rest renormalized.

    It is infinite where the cluster has a share above the tolerance; else only
    the others count, each of which gains: (1 - share) ln(1 - share), a little
    below 0. Without any mass it is 0.
    """
    total = F.sum("mass").over(Window.partitionBy("ctx_id"))
    share = F.when(total > 0, F.col("mass") / total).otherwise(F.lit(0.0))
    with_share = masses.withColumn("_share", share)
    kl: Column = F.when(F.col("_share") > TOLERANCE, F.lit(float("inf"))).otherwise((1 - F.col("_share")) * F.ln(1 - F.col("_share")))
    return with_share.withColumn("kl", kl).drop("_share")


def information_score(masses: DataFrame, threshold: float = 1e-3, least: int = 1) -> DataFrame:
    """Mass of the clusters that are kept: the ``least`` with the largest divergence and all that reach ``threshold``; a pruned one scores minus infinity."""
    rank = F.row_number().over(Window.partitionBy("ctx_id").orderBy(F.desc("kl"), F.desc("mass"), F.asc("cluster_id")))
    ranked = kl_of_removal(masses).withColumn("_rank", rank)
    kept = (F.col("_rank") <= least) | (F.col("kl") >= threshold)
    return ranked.withColumn("score", F.when(kept, F.col("mass")).otherwise(F.lit(float("-inf")))).drop("_rank", "kl")


SCORES = {"greedy": greedy_score, "confidence": confidence_score, "information": information_score}


def register(name: str, score) -> None:
    """Makes a rule known under a new name: a function of masses (ctx_id, cluster_id, mass, size, ...) that adds score."""
    if name in SCORES:
        raise ValueError(f"rule {name} is known already")
    SCORES[name] = score


def best_cluster(scored: DataFrame) -> DataFrame:
    """ctx_id and the cluster with the best score, the lowest id on ties, with all its columns."""
    top = F.max_by(F.struct(*[c for c in scored.columns if c != "ctx_id"]), F.struct(F.col("score"), -F.col("cluster_id"))).alias("x")
    return scored.groupBy("ctx_id").agg(top).select("ctx_id", "x.*")


def allowed_token(clustered: DataFrame, best: DataFrame, allowed: DataFrame) -> DataFrame:
    """ctx_id, token_id: the likeliest allowed token of the best cluster.

    Where the cluster has none, the first allowed candidate by rank; where there
    is none, the lowest allowed token, candidate or not. A context that
    ``allowed`` doesn't name is not filtered. Rows: (ctx_id, token_id, rank,
    cluster_id, p); ``best``: ctx_id, cluster_id.
    """
    by_context = allowed.groupBy("ctx_id").agg(F.collect_set("token_id").alias("_allowed"))
    rows = clustered.join(best.select("ctx_id", F.col("cluster_id").alias("_best")), "ctx_id").join(by_context, "ctx_id", "left")
    fits = F.col("_allowed").isNull() | F.array_contains("_allowed", F.col("token_id"))
    inside = F.when(fits & (F.col("cluster_id") == F.col("_best")), F.struct(F.col("p"), -F.col("token_id")))
    picked = rows.groupBy("ctx_id").agg(
        F.max_by("token_id", inside).alias("_in"), F.min_by("token_id", F.when(fits, F.col("rank"))).alias("_first"), F.array_min(F.first("_allowed")).alias("_least"))
    return picked.select("ctx_id", F.coalesce("_in", "_first", "_least").alias("token_id"))
