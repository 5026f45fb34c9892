"""The input relations of the selection queries, derived from the tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.sources.tables import table

#: Distance below which tokens are neighbours in these tables.
EPSILON = 0.7


def logits(spark: SparkSession, sf_dir: str, scale: float = 100.0) -> DataFrame:
    """(ctx_id, token_id, logit): a user's largest value for each key, divided by ``scale``."""
    events = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("token_id"), "value")
    return events.groupBy(F.col("user_id").alias("ctx_id"), "token_id").agg((F.max("value") / scale).alias("logit"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, vec, label) of the whole embeddings table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("token_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, vec, label) of the tokens that occur in the logits."""
    tokens = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("token_id")).distinct()
    return vectors(spark, sf_dir).join(tokens, "token_id", "left_semi")


def allowed(rows: DataFrame, modulus: int = 4) -> DataFrame:
    """(ctx_id, token_id): the tokens of the context's residue class."""
    return rows.where(F.pmod("token_id", F.lit(modulus)) == F.pmod("ctx_id", F.lit(modulus))).select("ctx_id", "token_id")


def logits_sql(scale: float = 100.0, name: str = "logits") -> str:
    return f"{name} AS (SELECT user_id AS ctx_id, CAST(json_extract_string(props, '$.k') AS INT) AS token_id, max(value) / {scale} AS logit FROM events GROUP BY 1, 2)"


VECTORS_SQL = "vocab AS (SELECT CAST(vec_id AS INT) AS token_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
VOCABULARY_SQL = VECTORS_SQL[:-1] + " WHERE vec_id IN (SELECT CAST(json_extract_string(props, '$.k') AS INT) FROM events))"


def allowed_sql(modulus: int = 4, name: str = "allowed", source: str = "logits") -> str:
    return f"{name} AS (SELECT ctx_id, token_id, logit FROM {source} WHERE token_id % {modulus} = ctx_id % {modulus})"


def softmax_sql(source: str, name: str = "soft", temperature: float = 1.0) -> str:
    scaled = f"logit / {temperature}"
    return (
        f"{name} AS (SELECT ctx_id, token_id, logit, e / sum(e) OVER (PARTITION BY ctx_id) AS p FROM "
        f"(SELECT *, exp({scaled} - max({scaled}) OVER (PARTITION BY ctx_id)) AS e FROM {source}))"
    )


def edges_sql(epsilon: float = EPSILON, name: str = "edges") -> str:
    return (
        f"{name} AS (SELECT a.token_id AS a, b.token_id AS b, 1 - list_cosine_similarity(a.vec, b.vec) AS distance "
        f"FROM vocab AS a JOIN vocab AS b ON a.token_id < b.token_id WHERE 1 - list_cosine_similarity(a.vec, b.vec) <= {epsilon})"
    )


def dynamic_sql(source: str = "logits", name: str = "cand", top: int = 50, least: int = 20, most: int = 100) -> str:
    """Dynamic candidates of ``source``."""
    return f"""
{softmax_sql(source, name + "_p")},
{name}_n AS (
  SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id) AS rank, count(*) OVER (PARTITION BY ctx_id) AS v,
         greatest({least}, least({most}, count(*) FILTER (p >= 0.001) OVER (PARTITION BY ctx_id))) AS m
  FROM {name}_p
),
{name} AS (SELECT ctx_id, token_id, logit, rank FROM {name}_n WHERE rank <= CASE WHEN m > v THEN least({top}, v) ELSE m END)"""


def clusters_sql(source: str = "cand", name: str = "clustered") -> str:
    """Components of the edges within each context, with probabilities over the candidates ``source``; needs WITH RECURSIVE."""
    return f"""
{softmax_sql(source, name + "_p")},
{name}_e AS (
  SELECT x.ctx_id, e.a, e.b FROM edges AS e JOIN {source} AS x ON x.token_id = e.a JOIN {source} AS y ON y.ctx_id = x.ctx_id AND y.token_id = e.b
),
{name}_s AS (SELECT ctx_id, a, b FROM {name}_e UNION ALL SELECT ctx_id, b, a FROM {name}_e),
{name}_r AS (
  SELECT ctx_id, token_id, token_id AS reached FROM {source}
  UNION
  SELECT r.ctx_id, r.token_id, s.b FROM {name}_r AS r JOIN {name}_s AS s ON s.ctx_id = r.ctx_id AND s.a = r.reached
),
{name}_c AS (SELECT ctx_id, token_id, min(reached) AS cluster_id FROM {name}_r GROUP BY ctx_id, token_id),
{name} AS (SELECT p.ctx_id, p.token_id, p.logit, p.p, c.cluster_id FROM {name}_p AS p JOIN {name}_c AS c USING (ctx_id, token_id))"""


def picked_sql(score: str, source: str = "clustered", name: str = "picked") -> str:
    """Mass, size and score of the clusters of ``source``, and the token picked from the best one."""
    return f"""
{name}_m AS (SELECT ctx_id, cluster_id, sum(p) AS mass, count(*) AS size FROM {source} GROUP BY 1, 2),
{name}_w AS (SELECT *, {score} AS score FROM {name}_m),
{name}_b AS (SELECT * FROM {name}_w QUALIFY row_number() OVER (PARTITION BY ctx_id ORDER BY score DESC, cluster_id) = 1),
{name} AS (
  SELECT s.ctx_id, s.token_id, s.cluster_id FROM {source} AS s JOIN {name}_b AS b ON b.ctx_id = s.ctx_id AND b.cluster_id = s.cluster_id
  QUALIFY row_number() OVER (PARTITION BY s.ctx_id ORDER BY s.p DESC, s.token_id) = 1
)"""


CONFIDENCE_SQL = "mass - 0.1 / size - 0.05 * (-mass * ln(mass + 1e-8))"
