"""Statistics as column expressions; Arrow functions where a special function is needed."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.96
#: Bounds of effect sizes, and of significance stars.
EFFECTS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval in percent, 0 and 0 for no trials."""
    p = successes / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    ends = ((centre - spread) / (1 + z * z / n) * 100, (centre + spread) / (1 + z * z / n) * 100)
    low, high = (F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), e))).otherwise(F.lit(0.0)) for e in ends)
    return low, high


def effect_label(d: Column) -> Column:
    out = None
    for bound, name in EFFECTS:
        out = F.when(F.abs(d) < bound, name) if out is None else out.when(F.abs(d) < bound, name)
    return out.otherwise("large")


def stars(p: Column) -> Column:
    out = None
    for bound, name in STARS:
        out = F.when(p < bound, name) if out is None else out.when(p < bound, name)
    return out.otherwise("ns")


def evidence_tier(p: Column) -> Column:
    """Five tiers of an exact test's p-value."""
    return F.when(p < 0.001, "very strong").when(p < 0.01, "strong").when(p < 0.05, "significant").when(p < 0.1, "marginal").otherwise("none")


def log_factorial(n: Column) -> Column:
    """ln(n!) of a whole number: exact sums up to 15, Stirling's series (to about 1e-14) beyond."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    z = F.greatest(n, F.lit(15)).cast("double") + 1
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return F.when(n <= 15, F.get(small, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def cohens_d(p1: Column, p2: Column) -> Column:
    """Difference of two proportions in pooled standard deviations; 0 where these are 0."""
    mean = (p1 + p2) / 2
    sd = F.sqrt(mean * (1 - mean))
    return F.when(sd > 0, (p1 - p2) / sd).otherwise(F.lit(0.0))


def required_n(effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Per group, for a two-sided test of two groups."""
    if effect == 0:
        raise ValueError("an effect of 0 can't be found")
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return math.ceil(2 * (z / effect) ** 2)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """p-value of a standard normal statistic."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if pd.notna(v) else None).astype(float)


@F.pandas_udf(T.DoubleType())
def chi2_1_upper(x: pd.Series) -> pd.Series:
    """p-value of a chi-square statistic with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if pd.notna(v) and v >= 0 else None).astype(float)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    return front * _continued_fraction(a, b, x)


def _continued_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """p-value of Student's t with df degrees of freedom."""
    return pd.Series([incomplete_beta(n / 2, 0.5, n / (n + v * v)) if pd.notna(v) and pd.notna(n) and n > 0 else None for v, n in zip(t, df)], dtype=float)
