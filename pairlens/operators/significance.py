"""Significance tests of samplers against each other, as aggregates."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions import statistics as st


def method_pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def paired(results: DataFrame, names: list[str]) -> DataFrame:
    """ctx_id, method1, method2, x1, x2: the verdicts (0 or 1) of each pair of samplers on the same context.

    One pivot, then one row per pair of the fixed list; nothing is joined.
    """
    wide = results.where(F.col("sampler").isin(names)).groupBy("ctx_id").agg(*[F.max(F.when(F.col("sampler") == n, F.col("correct").cast("int"))).alias(f"_{n}") for n in names])
    each = F.array(*[F.struct(F.lit(a).alias("method1"), F.lit(b).alias("method2"), F.col(f"_{a}").alias("x1"), F.col(f"_{b}").alias("x2")) for a, b in method_pairs(names)])
    return wide.select("ctx_id", F.explode(each).alias("x")).select("ctx_id", "x.*").where(F.col("x1").isNotNull() & F.col("x2").isNotNull())


def paired_t(pairs: DataFrame) -> DataFrame:
    """t of the differences, with the interval of their mean at 1.96 standard errors; null t without variance."""
    d = (F.col("x1") - F.col("x2")).cast("double")
    rows = pairs.groupBy("method1", "method2").agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return rows.withColumn("t", F.when(F.col("sd") > 0, F.col("mean_diff") / se)).withColumn("df", F.col("n") - 1).withColumn("ci_low", F.col("mean_diff") - st.Z95 * se).withColumn("ci_high", F.col("mean_diff") + st.Z95 * se)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Discordant counts b and c, the statistic with continuity correction (0 without any), odds b / c (infinite for c = 0)."""
    b, c = F.count_if((F.col("x1") == 1) & (F.col("x2") == 0)), F.count_if((F.col("x1") == 0) & (F.col("x2") == 1))
    rows = pairs.groupBy("method1", "method2").agg(b.alias("b"), c.alias("c"))
    n = F.col("b") + F.col("c")
    return rows.withColumn("statistic", F.when(n > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / n).otherwise(0.0)).withColumn("odds", F.when(F.col("c") > 0, F.col("b") / F.col("c")).otherwise(F.lit(float("inf"))))


def counts(pairs: DataFrame) -> DataFrame:
    """Right answers of both methods and the number of contexts."""
    return pairs.groupBy("method1", "method2").agg(F.sum("x1").alias("c1"), F.sum("x2").alias("c2"), F.count("*").alias("n"))


def two_proportion_z(rows: DataFrame) -> DataFrame:
    """Adds z of pooled proportions of c1 and c2 out of n each; 0 without spread."""
    p1, p2, p = F.col("c1") / F.col("n"), F.col("c2") / F.col("n"), (F.col("c1") + F.col("c2")) / (2 * F.col("n"))
    se = F.sqrt(p * (1 - p) * 2 / F.col("n"))
    return rows.withColumn("z", F.when(se > 0, (p1 - p2) / se).otherwise(0.0))


def effect(rows: DataFrame) -> DataFrame:
    """Adds d, its interval and its label."""
    d = st.cohens_d(F.col("c1") / F.col("n"), F.col("c2") / F.col("n"))
    with_d = rows.withColumn("d", d)
    half = st.Z95 * F.sqrt(2 / F.col("n") + F.col("d") * F.col("d") / (4 * F.col("n")))
    return with_d.withColumn("d_low", F.col("d") - half).withColumn("d_high", F.col("d") + half).withColumn("effect", st.effect_label(F.col("d")))


def fisher(rows: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Adds p_fisher of [[c1, n - c1], [c2, n - c2]]: the probability of all tables at most as likely; 1 without rows.

    Of the possible tables those within 40 standard deviations are summed; the
    rest adds nothing to a double. Weights come from one expression, relative
    to the likeliest table, so each pair is one grouping over its own rows.
    """
    n, k = F.col("n"), F.col("c1") + F.col("c2")
    half = 40 * F.sqrt(k / 4 * (2 * n - k) / F.greatest(2 * n - 1, F.lit(1))) + 50

    def weight(i: Column) -> Column:
        return -(st.log_factorial(i) + st.log_factorial(n - i) + st.log_factorial(k - i) + st.log_factorial(n - k + i))

    low = F.greatest(F.lit(0).cast("long"), k - n, F.floor(k / 2 - half).cast("long"))
    high = F.least(k, n, F.ceil(k / 2 + half).cast("long"))
    top = weight(F.floor(k / 2).cast("long"))
    bound = rows.withColumn("_top", top).withColumn("_own", weight(F.col("c1")) - F.col("_top"))
    each = bound.withColumn("_i", F.explode_outer(F.when(n > 0, F.sequence(low, high)))).withColumn("_w", weight(F.col("_i")) - F.col("_top"))
    near = F.col("_w") <= F.col("_own") + tolerance
    # the rows themselves are the grouping's keys, so nothing is joined back
    p = F.sum(F.when(near, F.exp("_w")).otherwise(0.0)) / F.sum(F.exp("_w"))
    return each.groupBy(*rows.columns).agg(F.least(F.lit(1.0), F.coalesce(p, F.lit(1.0))).alias("p_fisher"))


def bonferroni(rows: DataFrame, p: str, name: str = "p_bonferroni") -> DataFrame:
    return rows.withColumn(name, F.least(F.lit(1.0), F.col(p) * F.count("*").over(Window.partitionBy())))


def holm(rows: DataFrame, p: str, name: str = "p_holm", ties: tuple[str, ...] = ("method1", "method2")) -> DataFrame:
    """Step-down adjustment: the running maximum of (m - i) p over the ascending p. One row per pair of methods, so one task holds few."""
    order = Window.orderBy(F.asc(p), *ties)
    raised = rows.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    stepped = raised.withColumn("_s", F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_i") + 1)))
    return stepped.withColumn(name, F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_m", "_s")


def corrected(rows: DataFrame, p: str, method: str) -> DataFrame:
    if method not in ("bonferroni", "holm"):
        raise ValueError(f"unknown correction {method}")
    return bonferroni(rows, p) if method == "bonferroni" else holm(rows, p)


def bootstrap(results: DataFrame, rounds: int = 1000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """Per sampler an interval of the mean verdict from Poisson resamples.

    Weights of 1 on average per row add up, over all right and all wrong rows
    of a sampler, to Poisson numbers of their counts; so a round needs two draws
    and not one per row. Draws follow from the seed, the sampler and the round.
    """

    @F.pandas_udf("double")
    def resampled(name: pd.Series, round_: pd.Series, right: pd.Series, wrong: pd.Series) -> pd.Series:
        out = []
        for n, r, c, w in zip(name, round_, right, wrong):
            rng = np.random.default_rng([seed, int(r), crc32(str(n).encode())])
            a, b = rng.poisson(c), rng.poisson(w)
            out.append(a / (a + b) if a + b else None)
        return pd.Series(out, dtype=float)

    counted = results.groupBy("sampler").agg(F.count_if("correct").alias("_c"), F.count_if(~F.col("correct")).alias("_w"))
    each = counted.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    means = each.select("sampler", resampled("sampler", "_round", "_c", "_w").alias("mean"))
    ends = F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return means.groupBy("sampler").agg(ends.alias("e"), F.count("*").alias("rounds")).select("sampler", "rounds", F.col("e")[0].alias("ci_low"), F.col("e")[1].alias("ci_high"))
