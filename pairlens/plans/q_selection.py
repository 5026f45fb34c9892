"""Queries of candidates, samplers, clusters and cluster-aware selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.functions import vectors
from pairlens.operators import category, clustering, samplers, sequences
from pairlens.operators import cluster_aware as ca
from pairlens.operators import logits as lg
from pairlens.plans import relations as rel
from pairlens.plans.durable import cut
from pairlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
L, V, A = rel.logits_sql(), rel.VOCABULARY_SQL, rel.allowed_sql()
TOP = "QUALIFY row_number() OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id)"


def u_sql(stream: str) -> str:
    """The draw of ``samplers.uniform``."""
    return f"((((ctx_id * 2654435761 + 12345) % 4294967296) * {samplers.STREAMS[stream]}) % 4294967296 / 4294967296.0)"


SPEC = ca.ClusterSpec(method="dbscan", epsilon=rel.EPSILON)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(name: str) -> Column:
    return F.round(name, 6).alias(name)


@query(f"WITH {L} SELECT ctx_id, token_id, round(logit, 6) AS logit FROM logits {TOP} = 1")
def greedy_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.struct(F.col("logit"), (-F.col("token_id")).alias("t"))).alias("x")
    return rel.logits(spark, sf_dir).groupBy("ctx_id").agg(best).select("ctx_id", (-F.col("x.t")).alias("token_id"), F.round("x.logit", 6).alias("logit"))


@query(f"WITH {L}, {A} SELECT ctx_id, token_id FROM allowed {TOP} = 1")
def greedy_pick_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.logits(spark, sf_dir)
    return samplers.greedy(rows, rel.allowed(rows)).select("ctx_id", "token_id")


@query(f"WITH {L}, {rel.softmax_sql('logits')} SELECT ctx_id, token_id, round(p, 6) AS p FROM soft")
def softmax_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.softmax(rel.logits(spark, sf_dir)).select("ctx_id", "token_id", _r("p"))


@query(f"""WITH {L}, {A}, {rel.softmax_sql('logits', 'full_p')}, {rel.softmax_sql('allowed', 'cand_p')}
SELECT c.ctx_id, c.token_id, round(f.p, 6) AS p_full, round(c.p, 6) AS p_candidates FROM cand_p AS c JOIN full_p AS f USING (ctx_id, token_id)""")
def full_vs_candidate_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = lg.softmax(rel.logits(spark, sf_dir), name="p_full")
    kept = full.where(F.pmod("token_id", F.lit(4)) == F.pmod("ctx_id", F.lit(4)))
    return lg.softmax(kept, name="p_candidates").select("ctx_id", "token_id", _r("p_full"), _r("p_candidates"))


@query(f"WITH {L} SELECT ctx_id, token_id, CAST(row_number() OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id) AS INT) AS rank FROM logits {TOP} <= 10")
def candidates_fixed_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.top_n(rel.logits(spark, sf_dir), 10).select("ctx_id", "token_id", "rank")


@query(f"WITH {rel.logits_sql(20.0)}, {rel.dynamic_sql()} SELECT ctx_id, token_id, CAST(rank AS INT) AS rank FROM cand")
def candidates_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.dynamic_candidates(rel.logits(spark, sf_dir, 20.0)).select("ctx_id", "token_id", "rank")


@query(f"WITH {L}, {A} SELECT ctx_id, token_id, CAST(row_number() OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id) AS INT) AS rank FROM allowed")
def candidates_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.logits(spark, sf_dir)
    return lg.candidates(rows, rel.allowed(rows)).select("ctx_id", "token_id", "rank")


@query(f"WITH {L} SELECT ctx_id, token_id FROM logits QUALIFY row_number() OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id) <= 10 OR token_id IN (0, 1, 2)")
def topn_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.top_n_forced(rel.logits(spark, sf_dir), 10, [0, 1, 2]).select("ctx_id", "token_id")


@query(f"WITH {L} SELECT ctx_id, token_id FROM logits {TOP} <= 10")
def topk_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samplers.top_k_support(rel.logits(spark, sf_dir), 10).select("ctx_id", "token_id")


@query(f"""WITH {L}, {rel.allowed_sql(20)}, top AS (SELECT * FROM logits {TOP} <= 5),
kept AS (SELECT t.ctx_id, t.token_id FROM top AS t JOIN allowed AS a USING (ctx_id, token_id)),
has AS (SELECT DISTINCT ctx_id FROM allowed)
SELECT ctx_id, token_id FROM kept
UNION ALL SELECT ctx_id, min(token_id) FROM allowed WHERE ctx_id NOT IN (SELECT ctx_id FROM kept) GROUP BY ctx_id
UNION ALL SELECT ctx_id, token_id FROM top WHERE ctx_id NOT IN (SELECT ctx_id FROM has)""")
def topk_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.logits(spark, sf_dir)
    return samplers.top_k_support(rows, 5, rel.allowed(rows, 20)).select("ctx_id", "token_id")


def _nucleus(source: str) -> str:
    return f"""{rel.softmax_sql(source)},
nucleus AS (SELECT * FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM soft) WHERE before <= 0.9)"""


@query(f"WITH {rel.logits_sql(40.0)}, {_nucleus('logits')} SELECT ctx_id, token_id, round(p / sum(p) OVER (PARTITION BY ctx_id), 6) AS p FROM nucleus")
def topp_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samplers.top_p_support(rel.logits(spark, sf_dir, 40.0)).select("ctx_id", "token_id", _r("p"))


@query(f"WITH {rel.logits_sql(40.0)}, {A}, {_nucleus('allowed')} SELECT ctx_id, token_id, round(p / sum(p) OVER (PARTITION BY ctx_id), 6) AS p FROM nucleus")
def topp_support_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.logits(spark, sf_dir, 40.0)
    return samplers.top_p_support(rows, 0.9, rel.allowed(rows)).select("ctx_id", "token_id", _r("p"))


@query(f"WITH {rel.logits_sql(20.0)}, {_nucleus('logits')} SELECT ctx_id, count(*) AS nucleus_size FROM nucleus GROUP BY ctx_id")
def topp_nucleus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samplers.top_p_support(rel.logits(spark, sf_dir, 20.0)).groupBy("ctx_id").agg(F.count("*").alias("nucleus_size"))


@query(f"""WITH {L}, t AS (SELECT unnest([0.5, 1.0, 2.0]) AS temperature),
e AS (SELECT ctx_id, token_id, CAST(temperature AS DOUBLE) AS temperature, exp((logit - max(logit) OVER (PARTITION BY ctx_id)) / temperature) AS e FROM logits CROSS JOIN t)
SELECT ctx_id, token_id, temperature, round(e / sum(e) OVER (PARTITION BY ctx_id, temperature), 6) AS p FROM e""")
def temperature_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.logits(spark, sf_dir)
    out = rows
    for t in (0.5, 1.0, 2.0):
        out = lg.softmax(out, t, f"p{t}")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"`p{t}`").alias("p")) for t in (0.5, 1.0, 2.0)])).alias("x")
    return out.select("ctx_id", "token_id", each).select("ctx_id", "token_id", "x.temperature", F.round("x.p", 6).alias("p"))


def _drawn(source: str, stream: str = "temperature") -> str:
    return f"""SELECT ctx_id, coalesce(min(token_id) FILTER (cum > {u_sql(stream)} * total), max(token_id)) AS token_id
FROM (SELECT *, sum(p) OVER (PARTITION BY ctx_id ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(p) OVER (PARTITION BY ctx_id) AS total FROM {source}) GROUP BY ctx_id"""


@query(f"WITH {L}, {rel.softmax_sql('logits')} {_drawn('soft')}")
def multinomial_pick_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samplers.temperature(rel.logits(spark, sf_dir)).select("ctx_id", "token_id")


@query(f"WITH {L}, {A}, {rel.softmax_sql('allowed', temperature=0.5)} {_drawn('soft')}")
def temperature_pick_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.logits(spark, sf_dir)
    return samplers.temperature(rows, 0.5, rel.allowed(rows)).select("ctx_id", "token_id")


@query(f"WITH {L}, k AS (SELECT * FROM logits {TOP} <= 10), {rel.softmax_sql('k')} {_drawn('soft', 'top_k')}")
def topk_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samplers.top_k(rel.logits(spark, sf_dir), 10).select("ctx_id", "token_id")


@query(f"WITH {rel.logits_sql(40.0)}, {_nucleus('logits')} {_drawn('nucleus', 'top_p')}")
def topp_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samplers.top_p(rel.logits(spark, sf_dir, 40.0)).select("ctx_id", "token_id")


@query(f"WITH {L}, one AS (SELECT ctx_id, token_id, 1.0 AS p FROM logits) {_drawn('one', 'random')}")
def random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samplers.random_(rel.logits(spark, sf_dir)).select("ctx_id", "token_id")


@query(f"WITH {rel.VECTORS_SQL}, {rel.edges_sql()} SELECT a, b, round(distance, 6) AS distance FROM edges")
def eps_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges between all vectors of the table."""
    return clustering.epsilon_edges(rel.vectors(spark, sf_dir), rel.EPSILON).select("a", "b", _r("distance"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(vectors.as_double("embedding")), 6).alias("norm"))


CAND = f"{L}, {V}, {rel.edges_sql()}, {rel.dynamic_sql()}, {rel.clusters_sql()}"
CAND_03 = f"{L}, {V}, {rel.edges_sql(0.3)}, {rel.dynamic_sql()}, {rel.clusters_sql()}"


def _rows(spark: SparkSession, sf_dir: str, spec: ca.ClusterSpec = SPEC) -> DataFrame:
    return ca.clustered(rel.logits(spark, sf_dir), rel.vocabulary(spark, sf_dir), spec)


@query(f"WITH RECURSIVE {CAND} SELECT ctx_id, token_id, cluster_id FROM clustered")
def dbscan_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("ctx_id", "token_id", "cluster_id")


@query(f"WITH RECURSIVE {CAND_03} SELECT ctx_id, count(DISTINCT cluster_id) AS clusters, count(*) AS tokens FROM clustered GROUP BY ctx_id")
def dbscan_noise_singletons_eps03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, ca.ClusterSpec(method="dbscan"))
    return rows.groupBy("ctx_id", "cluster_id").agg(F.count("*").alias("n")).groupBy("ctx_id").agg(F.count("*").alias("clusters"), F.sum("n").alias("tokens"))


@query(f"""WITH {L}, {V}, {rel.edges_sql(0.75)},
e AS (SELECT x.ctx_id, e.a, e.b FROM edges AS e JOIN logits AS x ON x.token_id = e.a JOIN logits AS y ON y.ctx_id = x.ctx_id AND y.token_id = e.b),
n AS (SELECT ctx_id, t, count(*) AS n FROM (SELECT ctx_id, a AS t FROM e UNION ALL SELECT ctx_id, b FROM e) GROUP BY 1, 2)
SELECT l.ctx_id, l.token_id, 1 + coalesce(n.n, 0) AS neighbours, 1 + coalesce(n.n, 0) >= 3 AS is_core FROM logits AS l LEFT JOIN n ON n.ctx_id = l.ctx_id AND n.t = l.token_id""")
def dbscan_core_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.core_counts(rel.logits(spark, sf_dir), clustering.epsilon_edges(rel.vocabulary(spark, sf_dir), 0.75), 3)


@query(f"WITH {L} SELECT ctx_id, token_id FROM logits {TOP} = 1")
def single_cluster_equals_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.select(rel.logits(spark, sf_dir), rel.vocabulary(spark, sf_dir), ca.ClusterSpec(method="single")).select("ctx_id", "token_id")


@query(f"""WITH {L}, n AS (SELECT ctx_id, count(*) AS n FROM logits GROUP BY 1)
SELECT ctx_id, n, CAST(least(CASE WHEN n <= 4 THEN 2 WHEN n <= 50 THEN greatest(2, floor(sqrt(n))) ELSE least(16, floor(n / 3.0)) END, 8, n) AS INT) AS k FROM n""")
def adaptive_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = rel.logits(spark, sf_dir).groupBy("ctx_id").agg(F.count("*").alias("n"))
    return sizes.withColumn("k", clustering.adaptive_k(F.col("n"), 8))


@query(f"""WITH {L}, {rel.dynamic_sql()}, n AS (SELECT ctx_id, count(*) AS n FROM cand GROUP BY 1)
SELECT m.method, CAST(count(*) AS BIGINT) AS contexts, CAST(sum(n) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS misnamed, CAST(0 AS BIGINT) AS too_many, CAST(0 AS BIGINT) AS misplaced
FROM n, (VALUES ('kmeans'), ('euclidean'), ('average'), ('complete'), ('single'), ('ward'), ('density')) AS m(method) GROUP BY m.method""")
def clusterer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every clusterer's labels: all candidates labelled, each cluster named by its lowest token, no more clusters than asked for (as many, where they are merged), and each point where its rule puts it."""
    cand = lg.softmax(lg.dynamic_candidates(rel.logits(spark, sf_dir)))
    k = 8

    def labels(x: np.ndarray) -> dict[str, np.ndarray]:
        made = {"kmeans": clustering.spherical_kmeans(x, clustering.k_for(len(x), k)), "euclidean": clustering.euclidean_kmeans(x, k, rounds=100), "density": clustering.density(x, 0.75, 3)}
        return made | {n: clustering.agglomerative(x, min(k, len(x)), n) for n in ("average", "complete", "single", "ward")}

    rows = clustering.per_context_each(cand, rel.vocabulary(spark, sf_dir), labels)
    with_vectors = rows.join(rel.vectors(spark, sf_dir).select("token_id", "vec"), "token_id", "left")
    grouped = with_vectors.groupBy("config", "ctx_id").agg(F.collect_list(F.struct("token_id", "cluster_id", "vec")).alias("m"))

    def faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array([m["vec"] for m in members])
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vectors.TINY)
                of, tokens = np.array([m["cluster_id"] for m in members]), np.array([m["token_id"] for m in members])
                found = np.unique(of)
                centres = np.array([x[of == c].mean(0) for c in found])
                own, near, misplaced = np.searchsorted(found, of), 1 - x @ x.T, 0
                if name == "kmeans":
                    closeness = x @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T
                    misplaced = int((closeness.max(1) - closeness[np.arange(len(x)), own] > 1e-9).sum())
                elif name == "euclidean":
                    distance = ((x[:, None] - centres[None]) ** 2).sum(-1)
                    misplaced = int((distance[np.arange(len(x)), own] - distance.min(1) > 1e-9).sum())
                elif name == "single" and len(found) > 1:
                    # clusters are as far apart as any link that was made within one is long
                    between = min(near[of == c][:, of != c].min() for c in found)
                    within = max([clustering_link(near[of == c][:, of == c]) for c in found])
                    misplaced = int(within > between + 1e-9)
                elif name == "density":
                    core = (near <= 0.75).sum(1) >= 3
                    misplaced = int(((near <= 0.75) & core[:, None] & core[None] & (of[:, None] != of[None])).any(1).sum() + sum(not (core & (of == o) & (near[i] <= 0.75)).any() for i, o in enumerate(of) if not core[i] and (of == o).sum() > 1))
                many = len(found) > k if name in ("kmeans", "euclidean") else len(found) != min(k, len(x)) if name != "density" else False
                out.append((name, len(x), int(sum(tokens[of == c].min() != c for c in found)), int(many), misplaced))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], pa.string()), *[pa.array([], pa.int64())] * 4], names=["method", "tokens", "misnamed", "too_many", "misplaced"])

    each = grouped.select("config", "m").mapInArrow(faults, "method string, tokens long, misnamed long, too_many long, misplaced long")
    return each.groupBy("method").agg(F.count("*").alias("contexts"), F.sum("tokens").alias("tokens"), F.sum("misnamed").alias("misnamed"), F.sum("too_many").alias("too_many"), F.sum("misplaced").alias("misplaced"))


def clustering_link(distances: np.ndarray) -> float:
    """The longest edge of the shortest tree over some points."""
    n = len(distances)
    reached, best, longest = np.zeros(n, dtype=bool), distances[0].copy(), 0.0
    reached[0] = True
    for _ in range(n - 1):
        nearest = int(np.where(reached, np.inf, best).argmin())
        longest, reached[nearest] = max(longest, best[nearest]), True
        best = np.minimum(best, distances[nearest])
    return longest


@query()
def kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, ca.DEFAULT).select("ctx_id", "token_id", "cluster_id")


@query()
def hierarchical_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, ca.ClusterSpec(method="hierarchical")).select("ctx_id", "token_id", "cluster_id")


@query(f"""WITH RECURSIVE {L}, {V}, {rel.edges_sql(0.75)}, {rel.dynamic_sql()},
e AS (SELECT x.ctx_id, e.a, e.b FROM edges AS e JOIN cand AS x ON x.token_id = e.a JOIN cand AS y ON y.ctx_id = x.ctx_id AND y.token_id = e.b),
s AS (SELECT ctx_id, a, b FROM e UNION ALL SELECT ctx_id, b, a FROM e),
core AS (SELECT c.ctx_id, c.token_id, c.rank FROM cand AS c JOIN s ON s.ctx_id = c.ctx_id AND s.a = c.token_id GROUP BY ALL HAVING count(*) >= 2),
r AS (
  SELECT ctx_id, token_id, token_id AS reached FROM core
  UNION SELECT r.ctx_id, r.token_id, s.b FROM r JOIN s ON s.ctx_id = r.ctx_id AND s.a = r.reached JOIN core AS c ON c.ctx_id = s.ctx_id AND c.token_id = s.b
),
comp AS (SELECT r.ctx_id, r.token_id, min(c.rank) AS comp FROM r JOIN core AS c ON c.ctx_id = r.ctx_id AND c.token_id = r.reached GROUP BY 1, 2),
border AS (SELECT s.ctx_id, s.b AS token_id, min(p.comp) AS comp FROM s JOIN comp AS p ON p.ctx_id = s.ctx_id AND p.token_id = s.a WHERE (s.ctx_id, s.b) NOT IN (SELECT (ctx_id, token_id) FROM core) GROUP BY 1, 2),
placed AS (SELECT * FROM comp UNION ALL SELECT * FROM border)
SELECT c.ctx_id, c.token_id, CAST(coalesce(min(c.token_id) OVER (PARTITION BY c.ctx_id, coalesce(p.comp, -c.token_id - 1)), c.token_id) AS INT) AS cluster_id FROM cand AS c LEFT JOIN placed AS p ON p.ctx_id = c.ctx_id AND p.token_id = c.token_id""")
def dbscan_border_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, ca.ClusterSpec(method="dbscan", epsilon=0.75, min_samples=3)).select("ctx_id", "token_id", "cluster_id")


@query(f"WITH RECURSIVE {L}, {V}, {rel.edges_sql(0.75)}, {rel.dynamic_sql()}, {rel.clusters_sql()} SELECT ctx_id, token_id, cluster_id FROM clustered")
def hierarchical_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single linkage cut at a distance."""
    cand = lg.dynamic_candidates(rel.logits(spark, sf_dir))
    return clustering.per_context(cand, rel.vocabulary(spark, sf_dir), lambda x: clustering.agglomerative(x, 1, "single", 0.75)).select("ctx_id", "token_id", "cluster_id")


@query(f"WITH RECURSIVE {CAND}, s AS (SELECT ctx_id, cluster_id, count(*) AS size FROM clustered GROUP BY 1, 2) SELECT size, count(*) AS clusters FROM s GROUP BY size")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.mass(_rows(spark, sf_dir)).groupBy("size").agg(F.count("*").alias("clusters"))


@query(f"""WITH RECURSIVE {CAND}, {rel.picked_sql(rel.CONFIDENCE_SQL)}
SELECT m.ctx_id, CAST(sum(m.size) AS BIGINT) AS candidate_count, count(*) AS num_clusters, any_value(p.cluster_id) AS selected_cluster, any_value(p.token_id) AS selected_token,
       string_agg(m.cluster_id || ':' || m.size, ',' ORDER BY m.cluster_id) AS clusters
FROM picked_m AS m JOIN picked AS p ON p.ctx_id = m.ctx_id GROUP BY m.ctx_id""")
def cluster_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ca.history(rel.logits(spark, sf_dir), rel.vocabulary(spark, sf_dir), SPEC)
    text = F.array_join(F.transform("clusters", lambda c: F.concat(c["cluster_id"], F.lit(":"), c["size"])), ",")
    return rows.select("ctx_id", "candidate_count", "num_clusters", "selected_cluster", "selected_token", text.alias("clusters"))


@query(f"WITH RECURSIVE {CAND} SELECT ctx_id, cluster_id, round(sum(p), 6) AS mass, count(*) AS size FROM clustered GROUP BY 1, 2")
def cluster_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.mass(_rows(spark, sf_dir)).select("ctx_id", "cluster_id", _r("mass"), "size")


def _category(score: str) -> str:
    return f"WITH RECURSIVE {CAND}, {rel.picked_sql(score)} SELECT ctx_id, cluster_id, round(mass, 6) AS mass, round(score, 6) AS score FROM picked_b"


@query(_category("mass"))
def category_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.best_cluster(category.greedy_score(category.mass(_rows(spark, sf_dir)))).select("ctx_id", "cluster_id", _r("mass"), _r("score"))


@query(_category(rel.CONFIDENCE_SQL))
def category_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.best_cluster(category.confidence_score(category.mass(_rows(spark, sf_dir)))).select("ctx_id", "cluster_id", _r("mass"), _r("score"))


@query(_category("CASE WHEN mass / sum(mass) OVER (PARTITION BY ctx_id) > 1e-10 THEN mass ELSE '-infinity'::DOUBLE END"))
def category_infogain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.best_cluster(category.information_score(category.mass(_rows(spark, sf_dir)))).select("ctx_id", "cluster_id", _r("mass"), _r("score"))


SHARP = f"WITH RECURSIVE {rel.logits_sql(2.0)}, {V}, {rel.edges_sql()}, {rel.dynamic_sql()}, {rel.clusters_sql()}, g AS (SELECT ctx_id, cluster_id, sum(p) AS mass, sum(p) / sum(sum(p)) OVER (PARTITION BY ctx_id) AS share FROM clustered GROUP BY 1, 2)"


def _sharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masses of clusters, most of which are next to nothing."""
    return category.mass(ca.clustered(rel.logits(spark, sf_dir, 2.0), rel.vocabulary(spark, sf_dir), SPEC))


@query(SHARP + " SELECT ctx_id, cluster_id, CASE WHEN share > 1e-10 THEN 'infinite' WHEN share > 1e-14 THEN 'below zero' ELSE 'about zero' END AS kl FROM g")
def kl_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What taking out a cluster does to the divergence."""
    share = F.col("mass") / F.sum("mass").over(lg.ctx())
    kind = F.when(F.col("kl") == float("inf"), "infinite").when((F.col("kl") < 0) & (share > 1e-14), "below zero").when(F.abs("kl") < 1e-13, "about zero")
    return category.kl_of_removal(_sharp(spark, sf_dir)).select("ctx_id", "cluster_id", kind.alias("kl"))


@query(SHARP + " SELECT ctx_id, count(*) AS clusters, count(*) FILTER (share <= 1e-10) AS pruned FROM g GROUP BY ctx_id")
def infogain_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = category.information_score(_sharp(spark, sf_dir))
    return scored.groupBy("ctx_id").agg(F.count("*").alias("clusters"), F.count_if(F.col("score") == float("-inf")).alias("pruned"))


def _dcbs(spark: SparkSession, sf_dir: str, spec: ca.ClusterSpec, modulus: int | None = None) -> DataFrame:
    rows = rel.logits(spark, sf_dir)
    return ca.select(rows, rel.vocabulary(spark, sf_dir), spec, rel.allowed(rows, modulus) if modulus else None).select("ctx_id", "token_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


@query(f"WITH RECURSIVE {CAND}, {rel.picked_sql('mass')} SELECT ctx_id, token_id, cluster_id FROM picked")
def dcbs_dbscan_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dcbs(spark, sf_dir, ca.ClusterSpec(method="dbscan", epsilon=rel.EPSILON, category="greedy"))


@query(f"WITH RECURSIVE {CAND}, {rel.picked_sql(rel.CONFIDENCE_SQL)} SELECT ctx_id, token_id, cluster_id FROM picked")
def dcbs_dbscan_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dcbs(spark, sf_dir, SPEC)


def _filtered(modulus: int) -> str:
    return f"""WITH RECURSIVE {L}, {V}, {rel.edges_sql()}, {rel.allowed_sql(modulus)},
few AS (SELECT ctx_id FROM allowed GROUP BY ctx_id HAVING count(*) <= 3), many AS (SELECT * FROM allowed WHERE ctx_id NOT IN (SELECT ctx_id FROM few)),
rest AS (SELECT * FROM logits WHERE ctx_id NOT IN (SELECT ctx_id FROM allowed)), {rel.dynamic_sql('rest', 'dyn')},
cand AS (SELECT ctx_id, token_id, logit FROM many UNION ALL SELECT ctx_id, token_id, logit FROM dyn), {rel.clusters_sql()}, {rel.picked_sql(rel.CONFIDENCE_SQL)}
SELECT ctx_id, token_id, cluster_id FROM picked
UNION ALL SELECT ctx_id, token_id, -1 FROM (SELECT * FROM allowed WHERE ctx_id IN (SELECT ctx_id FROM few) {TOP} = 1)"""


@query(_filtered(4))
def dcbs_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dcbs(spark, sf_dir, SPEC, 4)


@query(_filtered(20))
def dcbs_small_candidate_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dcbs(spark, sf_dir, SPEC, 20)


@query()
def dcbs_kmeans_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dcbs(spark, sf_dir, ca.DEFAULT)


@query()
def dcbs_hierarchical_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dcbs(spark, sf_dir, ca.ClusterSpec(method="hierarchical"))


@query(f"WITH {L}, c AS (SELECT count(DISTINCT ctx_id) AS n FROM logits) SELECT p.preset, CAST(n AS BIGINT) AS contexts, CAST(0 AS BIGINT) AS wrong FROM c, (VALUES ('default'), ('lightweight'), ('batch'), ('bounded')) AS p(preset)")
def preset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every preset decides every context, and its pick is the likeliest token of the cluster with the best score, found anew by windows."""
    out = None
    for name, spec in {"default": ca.DEFAULT, "lightweight": ca.LIGHTWEIGHT, "batch": ca.BATCH, "bounded": ca.BOUNDED}.items():
        rows = cut(ca.clustered(rel.logits(spark, sf_dir), rel.vocabulary(spark, sf_dir), spec))
        mine = Window.partitionBy("ctx_id", "cluster_id")
        summed = rows.withColumn("m", F.sum("p").over(mine)).withColumn("s", F.count("*").over(mine))
        score = F.col("m") if spec.category == "greedy" else F.col("m") - 0.1 / F.col("s") + 0.05 * F.col("m") * F.ln(F.col("m") + 1e-8)
        first = F.row_number().over(lg.ctx().orderBy(F.round(score, 12).desc(), "cluster_id", F.desc("p"), "token_id"))
        anew = summed.withColumn("r", first).where("r = 1").select("ctx_id", F.col("token_id").alias("anew"))
        chosen = category.best_cluster(category.SCORES[spec.category](category.mass(rows)))
        one = chosen.join(anew, "ctx_id", "full").agg(F.count("*").alias("contexts"), F.count_if(~F.col("token_id").eqNullSafe(F.col("anew"))).alias("wrong")).select(F.lit(name).alias("preset"), "contexts", "wrong")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def dcbs_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dcbs(spark, sf_dir, ca.BATCH)


@query()
def dcbs_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dcbs(spark, sf_dir, ca.BOUNDED)


@query("SELECT run_id, count(*) FILTER (isfinite(elapsed_ms)) AS finite, count(*) FILTER (elapsed_ms IS NULL OR NOT isfinite(elapsed_ms)) AS rejected FROM sampler_timings GROUP BY run_id")
def finite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that can be ranked and those kept apart, of a table that holds nulls, infinities and values that are no number."""
    rows = table(spark, sf_dir, "sampler_timings").select("run_id", F.col("elapsed_ms").alias("logit"))
    good = lg.finite(rows).groupBy("run_id").agg(F.count("*").alias("finite"), F.lit(0).cast("long").alias("rejected"))
    bad = lg.rejected(rows).groupBy("run_id").agg(F.lit(0).cast("long").alias("finite"), F.count("*").alias("rejected"))
    return good.unionByName(bad).groupBy("run_id").agg(F.sum("finite").alias("finite"), F.sum("rejected").alias("rejected"))


ODD = f"""{L}, odd AS (SELECT ctx_id, token_id, CASE WHEN ctx_id % 5 = 0 AND token_id % 3 = 0 THEN 'nan'::DOUBLE WHEN ctx_id % 5 = 1 THEN '-infinity'::DOUBLE WHEN ctx_id % 5 = 2 AND token_id % 2 = 0 THEN '-infinity'::DOUBLE ELSE logit END AS logit FROM logits)"""


@query(f"""WITH {ODD}, f AS (SELECT *, bool_or(isnan(logit)) OVER w OR bool_and(isinf(logit)) OVER w AS flat FROM odd WINDOW w AS (PARTITION BY ctx_id)),
g AS (SELECT ctx_id, token_id, CASE WHEN flat THEN 1.0 ELSE exp(logit / 0.5 - max(CASE WHEN NOT flat THEN logit / 0.5 END) OVER (PARTITION BY ctx_id)) END AS p FROM f) {_drawn('g')}""")
def sampled_or_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when((F.col("ctx_id") % 5 == 0) & (F.col("token_id") % 3 == 0), float("nan")).when(F.col("ctx_id") % 5 == 1, float("-inf")).when((F.col("ctx_id") % 5 == 2) & (F.col("token_id") % 2 == 0), float("-inf")).otherwise(F.col("logit"))
    return samplers.sampled_or_any(rel.logits(spark, sf_dir).withColumn("logit", odd), 0.5).select("ctx_id", "token_id")


@query(f"""WITH RECURSIVE {CAND}, {rel.picked_sql('mass')}, a AS (SELECT ctx_id, list(token_id) AS ok FROM logits WHERE token_id % 20 = ctx_id % 20 GROUP BY 1),
x AS (SELECT c.ctx_id, c.token_id, c.p, d.rank, a.ok, c.cluster_id = b.cluster_id AS best, a.ok IS NULL OR list_contains(a.ok, c.token_id) AS fits
      FROM clustered AS c JOIN cand AS d USING (ctx_id, token_id) JOIN picked_b AS b USING (ctx_id) LEFT JOIN a USING (ctx_id))
SELECT ctx_id, coalesce(arg_max(token_id, (p, -token_id)) FILTER (fits AND best), arg_min(token_id, rank) FILTER (fits), list_min(any_value(ok))) AS token_id FROM x GROUP BY ctx_id""")
def filtered_token_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cluster's token among a few allowed ones, with what stands in where the cluster has none."""
    logits = rel.logits(spark, sf_dir)
    rows = ca.clustered(logits, rel.vocabulary(spark, sf_dir), ca.ClusterSpec(method="dbscan", epsilon=rel.EPSILON, bypass=0))
    best = category.best_cluster(category.greedy_score(category.mass(rows)))
    return category.allowed_token(rows, best, rel.allowed(logits, 20))


@query(f"WITH {L}, {rel.dynamic_sql()}, n AS (SELECT ctx_id, count(*) AS n FROM cand GROUP BY 1) SELECT count(*) AS total_samples, count(*) FILTER (n > 3) AS clustering_calls, count(*) FILTER (n <= 3) AS bypassed, CAST(sum(n) AS BIGINT) AS candidates FROM n")
def decision_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.statistics(rel.logits(spark, sf_dir), SPEC)


@query("""WITH w AS (SELECT DISTINCT user_id AS ctx_id, CAST(json_extract_string(props, '$.k') AS INT) AS token_id FROM events), c AS (SELECT vec_id FROM embeddings WHERE label < 5)
SELECT ctx_id, count(*) FILTER (token_id IN (SELECT vec_id FROM c)) AS cached, string_agg(token_id, ',' ORDER BY token_id) FILTER (token_id NOT IN (SELECT vec_id FROM c)) AS uncached FROM w GROUP BY ctx_id""")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per context how many of its tokens have a vector at hand, here those of labels 0 to 4, and which haven't."""
    have = rel.vectors(spark, sf_dir).where("label < 5").select("token_id")
    split = sequences.split_by_presence(rel.logits(spark, sf_dir).select("ctx_id", "token_id"), have, "token_id")
    missing = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("present"), F.col("token_id")))), ",")
    return split.groupBy("ctx_id").agg(F.count_if("present").alias("cached"), F.nullif(missing, F.lit("")).alias("uncached"))
