"""The logits relation (ctx_id, token_id, logit): candidates and probabilities.

All windows partition by ctx_id, so that consecutive steps share one exchange.
Ties go to the lowest token_id. Logits that are null or not finite belong to
``rejected`` and must be taken out by ``finite`` before any ranking, since a
NaN would rank first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Bounds and threshold of the dynamic number of candidates.
LEAST, MOST, THRESHOLD = 20, 100, 0.001


def ctx() -> WindowSpec:
    """The rows of a context."""
    return Window.partitionBy("ctx_id")


def by_logit() -> WindowSpec:
    """The rows of a context from the highest logit on, the lowest token first on ties."""
    return ctx().orderBy(F.desc("logit"), F.asc("token_id"))


def _bad(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def finite(logits: DataFrame) -> DataFrame:
    """Rows whose logit can be ranked."""
    return logits.where(~_bad(F.col("logit")))


def rejected(logits: DataFrame) -> DataFrame:
    """Rows that ``finite`` leaves out."""
    return logits.where(_bad(F.col("logit")))


def strict(logits: DataFrame) -> DataFrame:
    """As ``logits``; a value that is not finite raises an error when it is read."""
    message = F.concat(F.lit("logit is not finite in context "), F.col("ctx_id").cast("string"))
    return logits.withColumn("logit", F.when(_bad(F.col("logit")), F.raise_error(message).cast("double")).otherwise(F.col("logit")))


def allow(logits: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Only allowed tokens; a context without any row in ``allowed`` (or no table at all) is not filtered."""
    if allowed is None:
        return logits
    # rows and allowed tokens meet in one grouping by context and token; a context with an allowed token is filtered
    columns = [c for c in logits.columns if c not in ("ctx_id", "token_id")]
    mine = logits.select("ctx_id", "token_id", F.struct(*columns).alias("_row"), F.lit(False).alias("_hit"))
    theirs = allowed.select(F.col("ctx_id").cast(logits.schema["ctx_id"].dataType), F.col("token_id").cast(logits.schema["token_id"].dataType), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_hit")).distinct()
    both = mine.unionByName(theirs).repartition("ctx_id")
    hit, filtered = F.max("_hit").over(Window.partitionBy("ctx_id", "token_id")), F.max("_hit").over(ctx())
    marked = both.withColumn("_ok", hit).withColumn("_filtered", filtered).where(F.col("_row").isNotNull() & (F.col("_ok") | ~F.col("_filtered")))
    return marked.select("ctx_id", "token_id", "_row.*")


def softmax(logits: DataFrame, temperature: float = 1.0, name: str = "p") -> DataFrame:
    """Adds the probability of each row within its context, stable against large logits."""
    if not temperature > 0:
        raise ValueError(f"temperature must be positive, not {temperature}")
    scaled = F.col("logit") / F.lit(temperature)
    raised = logits.withColumn("_e", F.exp(scaled - F.max(scaled).over(ctx())))
    return raised.withColumn(name, F.col("_e") / F.sum("_e").over(ctx())).drop("_e")


def top_n(logits: DataFrame, n: int) -> DataFrame:
    """The n highest logits of each context, with their rank."""
    if n < 1:
        raise ValueError(f"n must be at least 1, not {n}")
    return logits.withColumn("rank", F.row_number().over(by_logit())).where(F.col("rank") <= n)


def top_n_forced(logits: DataFrame, n: int, forced: list[int]) -> DataFrame:
    """The n highest and any of ``forced`` that the context has."""
    ranked = logits.withColumn("rank", F.row_number().over(by_logit()))
    return ranked.where((F.col("rank") <= n) | F.col("token_id").isin(forced))


def dynamic_candidates(logits: DataFrame, top: int = 50, dynamic: bool = True, least: int = LEAST, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """Candidates: as many of the highest as have a probability of ``threshold``, but from ``least`` to ``most``.

    If that is more than the context has, ``top`` counts instead. The constant
    cut at ``most`` comes first, so the ranking keeps a bounded number of rows.
    """
    n_all, n_likely = F.count("*").over(ctx()), F.sum((F.col("p") >= threshold).cast("int")).over(ctx())
    counted = softmax(logits).withColumn("_all", n_all).withColumn("_n", F.greatest(F.lit(least), F.least(F.lit(most), n_likely)))
    wanted = F.when(F.col("_n") > F.col("_all"), F.least(F.lit(top), F.col("_all"))).otherwise(F.col("_n")) if dynamic else F.least(F.lit(top), F.col("_all"))
    ranked = counted.withColumn("rank", F.row_number().over(by_logit())).where(F.col("rank") <= max(most, top))
    return ranked.where(F.col("rank") <= wanted).drop("_all", "_n", "p")


def candidates(logits: DataFrame, allowed: DataFrame | None = None, top: int = 50, dynamic: bool = True) -> DataFrame:
    """ctx_id, token_id, logit, rank: all allowed tokens where a context is filtered, else the dynamic candidates."""
    if allowed is None:
        return dynamic_candidates(logits, top, dynamic)
    contexts = allowed.select("ctx_id").distinct()
    chosen = logits.join(allowed.select("ctx_id", "token_id").distinct(), ["ctx_id", "token_id"], "left_semi").withColumn("rank", F.row_number().over(by_logit()))
    return chosen.unionByName(dynamic_candidates(logits.join(contexts, "ctx_id", "left_anti"), top, dynamic))


def wide_to_long(df: DataFrame, key: str = "ctx_id", values: str = "logits") -> DataFrame:
    """Array of logits per context to rows; the index is the token."""
    return df.select(F.col(key).alias("ctx_id"), F.posexplode(values).alias("token_id", "logit"))
