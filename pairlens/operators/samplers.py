"""Selection of one token per context. Every sampler returns (ctx_id, sampler, token_id)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators import logits as lg

_MODULUS = 4294967296
#: Multipliers that give each sampler draws of its own.
STREAMS = {"temperature": 1, "top_k": 747796405, "top_p": 625341585, "random": 277803737}


def uniform(seed: int = 12345, stream: str = "temperature") -> Column:
    """A number from [0, 1) per context and sampler by integer arithmetic alone: the same in any engine, order and partitioning."""
    base = F.pmod(F.pmod(F.col("ctx_id").cast("long"), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed), F.lit(_MODULUS))
    return F.pmod(base * F.lit(STREAMS[stream]), F.lit(_MODULUS)).cast("double") / F.lit(float(_MODULUS))


def best(rows: DataFrame, by: str = "logit") -> DataFrame:
    """Highest ``by`` per context, the lowest token on ties; partial aggregation before its one exchange."""
    return rows.groupBy("ctx_id").agg(F.max_by("token_id", F.struct(F.col(by), -F.col("token_id"))).alias("token_id"))


def _named(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("ctx_id", F.lit(name).alias("sampler"), "token_id")


def greedy(logits: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The highest allowed logit. A context whose allowed tokens have no logit gives no row."""
    return _named(best(lg.allow(logits, allowed)), "greedy")


def draw(weighted: DataFrame, seed: int = 12345, stream: str = "temperature") -> DataFrame:
    """One token per context by inverse cumulative probability ``p``, in the order of tokens."""
    order = lg.ctx().orderBy("token_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = weighted.withColumn("_cum", F.sum("p").over(order)).withColumn("_all", F.sum("p").over(lg.ctx()))
    hit = F.col("_cum") > uniform(seed, stream) * F.col("_all")
    return reached.groupBy("ctx_id").agg(F.coalesce(F.min(F.when(hit, F.col("token_id"))), F.max("token_id")).alias("token_id"))


def decide(logits: DataFrame, nucleus: float = 0.9, seed: int = 12345) -> DataFrame:
    """ctx_id, sampler, token_id, p, rank of greedy, top_p and random, for all of them in one exchange.

    p and rank are those among all tokens of the context. The picks equal those
    of the single samplers.
    """
    before = F.coalesce(F.sum("p").over(lg.by_logit().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = lg.softmax(logits).withColumn("rank", F.row_number().over(lg.by_logit())).withColumn("_in", F.when(before <= nucleus, F.col("p")).otherwise(0.0))
    order = lg.ctx().orderBy("token_id")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = ranked.withColumn("_cum", F.sum("_in").over(up_to)).withColumn("_n", F.row_number().over(order)).withColumn("_all", F.sum("_in").over(lg.ctx())).withColumn("_count", F.count("*").over(lg.ctx()))
    pick = F.struct("token_id", "p", "rank")
    kept = F.col("_in") > 0
    picks = reached.groupBy("ctx_id").agg(
        F.min_by(pick, "rank").alias("greedy"),
        F.coalesce(F.min(F.when(kept & (F.col("_cum") > uniform(seed, "top_p") * F.col("_all")), pick)), F.max(F.when(kept, pick))).alias("top_p"),
        F.coalesce(F.min(F.when(F.col("_n") > uniform(seed, "random") * F.col("_count"), pick)), F.max(pick)).alias("random"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("sampler"), F.col(f"{n}.token_id").alias("token_id"), F.col(f"{n}.p").alias("p"), F.col(f"{n}.rank").alias("rank")) for n in ("greedy", "top_p", "random")])).alias("x")
    return picks.select("ctx_id", each).select("ctx_id", "x.*")


def temperature(logits: DataFrame, t: float = 1.0, allowed: DataFrame | None = None, seed: int = 12345) -> DataFrame:
    """Drawn from softmax(logit / t); where no allowed token has a logit, the highest of all."""
    kept = lg.allow(logits, allowed)
    drawn = draw(lg.softmax(kept, t), seed)
    if allowed is not None:
        drawn = drawn.unionByName(best(logits.join(kept.select("ctx_id").distinct(), "ctx_id", "left_anti")))
    return _named(drawn, "temperature")


def sampled_or_any(logits: DataFrame, t: float = 1.0, allowed: DataFrame | None = None, seed: int = 12345) -> DataFrame:
    """Drawn from softmax(logit / t); where a logit is no number or all are infinite, any token of the context (or its allowed ones) with equal chances.

    A null logit counts as no number. An infinite one beside finite ones wins
    if positive and has no chance if negative.
    """
    kept = lg.allow(logits, allowed)
    value = F.col("logit") / F.lit(t)
    odd = F.col("logit").isNull() | F.isnan("logit")
    flat = F.max(odd).over(lg.ctx()) | F.min(F.abs(F.coalesce("logit", F.lit(0.0))) == float("inf")).over(lg.ctx())
    marked = kept.withColumn("_flat", flat)
    top = F.max(F.when(~F.col("_flat"), value)).over(lg.ctx())
    e = F.when(value == top, F.lit(1.0)).otherwise(F.exp(value - top))
    weighted = marked.withColumn("p", F.when(F.col("_flat"), F.lit(1.0)).otherwise(e))
    return _named(draw(weighted, seed), "sampled")


def top_k_support(logits: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Rows that top-k draws from: the k highest of all tokens, then the allowed ones among them.

    Where none is left, the allowed token with the lowest id that has a logit;
    where there is none, the highest of all.
    """
    if not isinstance(k, int) or k < 1:
        raise ValueError(f"k must be a positive integer, not {k}")
    top = lg.top_n(logits, k).drop("rank")
    if allowed is None:
        return top
    kept = lg.allow(top, allowed)
    empty = logits.join(kept.select("ctx_id").distinct(), "ctx_id", "left_anti")
    valid = empty.join(allowed.select("ctx_id", "token_id").distinct(), ["ctx_id", "token_id"], "left_semi")
    first = valid.groupBy("ctx_id").agg(F.min_by(F.struct("token_id", "logit"), "token_id").alias("x")).select("ctx_id", "x.*")
    none = empty.join(valid.select("ctx_id").distinct(), "ctx_id", "left_anti")
    highest = none.groupBy("ctx_id").agg(F.max_by(F.struct("token_id", "logit"), F.struct("logit", -F.col("token_id"))).alias("x")).select("ctx_id", "x.*")
    return kept.unionByName(first).unionByName(highest)


def top_k(logits: DataFrame, k: int, allowed: DataFrame | None = None, seed: int = 12345) -> DataFrame:
    return _named(draw(lg.softmax(top_k_support(logits, k, allowed)), seed, "top_k"), "top_k")


def top_p_support(logits: DataFrame, p: float = 0.9, allowed: DataFrame | None = None) -> DataFrame:
    """The nucleus: tokens before which the cumulative probability is at most p; p is renormalized."""
    before = F.coalesce(F.sum("p").over(lg.by_logit().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = lg.softmax(lg.allow(logits, allowed)).withColumn("_before", before).where(F.col("_before") <= p).drop("_before")
    return kept.withColumn("p", F.col("p") / F.sum("p").over(lg.ctx()))


def top_p(logits: DataFrame, p: float = 0.9, allowed: DataFrame | None = None, seed: int = 12345) -> DataFrame:
    return _named(draw(top_p_support(logits, p, allowed), seed, "top_p"), "top_p")


def random_(logits: DataFrame, allowed: DataFrame | None = None, seed: int = 12345) -> DataFrame:
    """Uniform over the allowed tokens, else over all of the context."""
    return _named(draw(lg.allow(logits, allowed).withColumn("p", F.lit(1.0)), seed, "random"), "random")


#: Samplers by name; each takes (logits, allowed).
REGISTRY: dict[str, Callable[..., DataFrame]] = {"greedy": greedy, "top_p": lambda logits, allowed=None: top_p(logits, 0.9, allowed), "random": random_}


def register(name: str, sampler: Callable[..., DataFrame]) -> None:
    """Makes a sampler known under a new name: a function of (logits, allowed) that gives (ctx_id, sampler, token_id)."""
    if name in REGISTRY or name in STREAMS:
        raise ValueError(f"sampler {name} is known already")
    REGISTRY[name] = sampler


def create(temperature_value: float | None = None, k: int | None = None) -> dict[str, Callable[..., DataFrame]]:
    """The registry with the samplers that need a parameter, where it is given."""
    out = dict(REGISTRY)
    if temperature_value is not None:
        out["temperature"] = lambda logits, allowed=None: temperature(logits, temperature_value, allowed)
    if k is not None:
        out["top_k"] = lambda logits, allowed=None: top_k(logits, k, allowed)
    return out


def run(logits: DataFrame, names: list[str], allowed: DataFrame | None = None, **parameters: float) -> DataFrame:
    """Rows of several samplers, one under another; an unknown name raises ValueError."""
    known = create(**parameters)
    missing = [n for n in names if n not in known]
    if missing or not names:
        raise ValueError(f"unknown samplers: {missing or names}")
    out = None
    for n in names:
        rows = known[n](logits, allowed)
        out = rows if out is None else out.unionByName(rows)
    return out
