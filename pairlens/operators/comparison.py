"""Datasets by clustering methods by samplers, as one table of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import cluster_aware as ca
from pairlens.operators import evaluation as ev
from pairlens.operators import samplers


def run(logits: DataFrame, embeddings: DataFrame, methods: dict[str, ca.ClusterSpec], names: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """method, sampler, ctx_id, token_id: the cluster-aware picks of each method, all made in one pass, and the picks of the other samplers, which are the same for each method and made once."""
    aware = ca.sweep(logits, embeddings, methods, allowed).select(F.col("config").alias("method"), F.lit("dcbs").alias("sampler"), "ctx_id", "token_id")
    plain = samplers.run(logits, names, allowed) if names else None
    if plain is None:
        return aware
    return aware.unionByName(plain.withColumn("method", F.explode(F.array(*map(F.lit, methods)))).select("method", "sampler", "ctx_id", "token_id"))


def summary(judged: DataFrame) -> DataFrame:
    """Per dataset, method and sampler of rows (dataset, method, sampler, correct): total, correct, accuracy."""
    return ev.accuracy(judged, "dataset", "method").select("dataset", "method", "sampler", "total", "correct", "accuracy")
