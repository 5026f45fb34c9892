"""From picks to results: answers, correctness, accuracy, disagreement, resuming.

Results are rows (ctx_id, sampler, token_id, correct, ...). Where a pair of
ctx_id and sampler occurs twice, statistics take the first, predictions the
last, as ``first_of`` and ``pivot`` say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions import statistics as st


def judged(picks: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``correct``: whether the token is one of the context's (ctx_id, token_id) in ``gold``."""
    right = gold.select("ctx_id", "token_id").distinct().withColumn("correct", F.lit(True))
    return picks.join(right, ["ctx_id", "token_id"], "left").withColumn("correct", F.coalesce("correct", F.lit(False)))


def gold_answer(options: Column, correct_option: Column) -> Column:
    """The option that a 1-based number in a string names; null if it names none."""
    n = F.coalesce(correct_option.try_cast("int"), F.lit(1))
    return F.when((n >= 1) & (n <= F.size(options)), F.element_at(options, n))


def token_match(predicted: Column, decoded: Column, answer: Column, answer_ids: Column) -> Column:
    """Whether a token counts as an answer of several tokens: it is one of them, or its text is the answer's."""
    same = F.lower(F.trim(decoded)) == F.lower(F.trim(answer))
    return F.coalesce(F.array_contains(answer_ids, predicted), F.lit(False)) | F.coalesce(same, F.lit(False))


def answer_of(pairs: Column, predicted: Column) -> Column:
    """The first option whose token was predicted, of an array of structs (option, token); null if none."""
    return F.get(F.filter(pairs, lambda x: x["token"] == predicted), F.lit(0))["option"]


def first_of(results: DataFrame, order: str = "pos") -> DataFrame:
    """One row per ctx_id and sampler: the first by ``order``."""
    w = Window.partitionBy("ctx_id", "sampler").orderBy(order)
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def accuracy(results: DataFrame, *by: str) -> DataFrame:
    """Per sampler (and ``by``): total, correct, accuracy in percent and Wilson's interval."""
    n, c = F.col("total"), F.col("correct")
    low, high = st.wilson(c, n)
    grouped = results.groupBy(*by, "sampler").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    return grouped.withColumn("accuracy", 100 * c / n).withColumn("ci_low", low).withColumn("ci_high", high)


def pivot(results: DataFrame, names: list[str], value: str = "correct", order: str | None = None) -> DataFrame:
    """One row per ctx_id with a column per sampler: its last value by ``order``. One exchange for any number of samplers."""
    kept = results.where(F.col("sampler").isin(names))
    pick = (lambda n: F.max_by(F.when(F.col("sampler") == n, F.col(value)), F.when(F.col("sampler") == n, F.col(order)))) if order else (lambda n: F.max(F.when(F.col("sampler") == n, F.col(value))))
    return kept.groupBy("ctx_id").agg(*[pick(n).alias(n) for n in names])


def outcome(one: Column, two: Column, one_name: str = "greedy", two_name: str = "dcbs") -> Column:
    """Who was right where two samplers differ."""
    return F.when(one & two, "both_correct").when(one, f"{one_name}_wins").when(two, f"{two_name}_wins").otherwise("both_wrong")


def differences(results: DataFrame, one: str = "greedy", two: str = "dcbs", *more: str) -> DataFrame:
    """Contexts on which two samplers pick different tokens, with both tokens, both verdicts, both values of the columns ``more``, and the outcome."""
    state = F.struct("token_id", "correct", *more)
    w = results.where(F.col("sampler").isin(one, two)).groupBy("ctx_id").agg(
        F.max(F.when(F.col("sampler") == one, state)).alias("a"), F.max(F.when(F.col("sampler") == two, state)).alias("b"))
    both = w.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.token_id") != F.col("b.token_id")))
    return both.select(
        "ctx_id", F.col("a.token_id").alias(f"{one}_token"), F.col("b.token_id").alias(f"{two}_token"), F.col("a.correct").alias(f"{one}_correct"), F.col("b.correct").alias(f"{two}_correct"),
        *[F.col(f"{x}.{m}").alias(f"{n}_{m}") for m in more for x, n in (("a", one), ("b", two))], outcome(F.col("a.correct"), F.col("b.correct"), one, two).alias("outcome"))


def decisive(differing: DataFrame, one: str = "greedy", two: str = "dcbs") -> DataFrame:
    """One row: wins of either sampler where only one was right, and the second one's share of them in percent (null of none)."""
    wins = differing.agg(F.count_if(F.col("outcome") == f"{two}_wins").alias(f"{two}_wins"), F.count_if(F.col("outcome") == f"{one}_wins").alias(f"{one}_wins"))
    return wins.withColumn(f"{two}_win_pct", F.try_divide(100.0 * F.col(f"{two}_wins"), F.col(f"{two}_wins") + F.col(f"{one}_wins")))


def likeliest(probabilities: DataFrame, n: int = 10) -> DataFrame:
    """ctx_id and "token:p,..." of its n likeliest tokens."""
    ranked = probabilities.withColumn("r", F.row_number().over(Window.partitionBy("ctx_id").orderBy(F.desc("p"), "token_id"))).where(F.col("r") <= n)
    listed = F.array_sort(F.collect_list(F.struct("r", F.concat("token_id", F.lit(":"), F.format_string("%.4f", "p")).alias("t"))))
    return ranked.groupBy("ctx_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("top"))


def ranked(rows: DataFrame, score: str, cost: str, name: str) -> DataFrame:
    """Adds rank: the highest score first, of equal ones the least cost, then the name. For summaries, whose rows are few."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc_nulls_last(cost), name)))


def best_so_far(rows: DataFrame, order: list[str], score: str, cost: str, name: str) -> DataFrame:
    """Adds best: the name of the best row up to each one, by ``ranked``'s rule. For summaries, whose rows are few."""
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct((-F.col(score)).alias("s"), F.col(cost).isNull().alias("n"), F.col(cost).alias("c"), F.col(name).alias("name"))
    return rows.withColumn("best", F.min(key).over(so_far)["name"])


def divergence(results: DataFrame, one: str = "greedy", two: str = "dcbs") -> DataFrame:
    """One row: contexts with both samplers, those that differ, and their share in percent (0 of none)."""
    wide = pivot(results, [one, two], "token_id").where(F.col(one).isNotNull() & F.col(two).isNotNull())
    return wide.agg(F.count("*").alias("contexts"), F.count_if(F.col(one) != F.col(two)).alias("differing")).withColumn(
        "divergence_pct", F.when(F.col("contexts") > 0, 100 * F.col("differing") / F.col("contexts")).otherwise(0.0))


def tier(p: Column) -> Column:
    return F.when(p > 0.95, "VERY HIGH").when(p > 0.8, "MEDIUM").otherwise("LOW")


def remaining(work: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("ctx_id", "sampler")) -> DataFrame:
    """Work that isn't done yet, by key and not by position: nothing that failed is passed over."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
