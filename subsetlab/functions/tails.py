"""Tail probabilities and quantiles of the normal, t, beta, binomial and chi-square distributions.

Spark has no built-in for these. They are vectorised pandas UDFs over rows that are already aggregated (one row per
comparison), so the Python side never sees the data, only its summary.
"""
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny, front, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            front = 1.0 + numerator / front
            front = front if abs(front) > tiny else tiny
            value *= d * front
        if abs(d * front - 1.0) < 1e-15:
            break
    return value


def beta_cdf(x, a, b):
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    head = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return head * _beta_fraction(a, b, x) / a
    return 1.0 - head * _beta_fraction(b, a, 1.0 - x) / b


def beta_quantile(p, a, b):
    """Inverse of ``beta_cdf`` by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if beta_cdf(middle, a, b) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def t_quantile(p, df):
    """Upper quantile (p > 0.5) of Student's t distribution."""
    x = beta_quantile(2.0 * (1.0 - p), df / 2.0, 0.5)
    return math.sqrt(df * (1.0 - x) / x) if x > 0 else float("inf")


def signed_rank_exact(w, n, side):
    """Exact Wilcoxon signed-rank p-value for ranks 1..n without ties or zeros."""
    ways = np.ones(1)
    for rank in range(1, n + 1):
        grown = np.zeros(len(ways) + rank)
        grown[:len(ways)] += ways
        grown[rank:] += ways
        ways = grown
    share = ways / ways.sum()
    at_least, at_most = share[int(math.ceil(w)):].sum(), share[:int(math.floor(w)) + 1].sum()
    return at_least if side == "greater" else min(1.0, 2.0 * min(at_least, at_most))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value of a z score."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    """Upper-tail normal p-value of a z score."""
    return z.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(v / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def exact_two_sided(w: pd.Series, n: pd.Series) -> pd.Series:
    """Exact two-sided signed-rank p-value of rows with at most 50 differences; null elsewhere."""
    return pd.Series([signed_rank_exact(a, int(b), "two") if a == a and b == b and 0 < b <= 50 else None for a, b in zip(w, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def exact_upper(w: pd.Series, n: pd.Series) -> pd.Series:
    """Exact one-sided signed-rank p-value of rows with at most 50 differences; null elsewhere."""
    return pd.Series([signed_rank_exact(a, int(b), "greater") if a == a and b == b and 0 < b <= 50 else None for a, b in zip(w, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def beta_ppf(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Beta quantile per row."""
    return pd.Series([beta_quantile(*row) if all(v == v for v in row) else None for row in zip(p, a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    """Student t quantile per row (p above one half)."""
    return pd.Series([t_quantile(q, d) if d == d and d > 0 else None for q, d in zip(p, df)], dtype="float64")


def chi_square_upper_even(statistic: Column, half_df: Column) -> Column:
    """Upper tail of a chi-square variable with an even number (2k) of degrees of freedom: a finite sum, no UDF."""
    half = statistic / 2.0
    terms = F.aggregate(F.sequence(F.lit(1), half_df.cast("int")),
                        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
                        lambda acc, i: F.struct((acc["term"] * half / i.cast("double")).alias("term"), (acc["sum"] + acc["term"]).alias("sum")),
                        lambda acc: acc["sum"])
    return F.exp(-half) * terms


def binomial_two_sided_half(successes: Column, n: Column) -> Column:
    """Two-sided exact sign test: probability, at one half, of a count at least as far from n/2."""
    extreme = F.greatest(successes, n - successes).cast("int")
    log_choose = lambda k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    tail = F.aggregate(F.sequence(extreme, n.cast("int")), F.lit(0.0),
                       lambda acc, k: acc + F.exp(log_choose(k) - n * F.lit(math.log(2.0))))
    return F.least(F.lit(1.0), F.lit(2.0) * tail)


def _log_factorial(k: Column) -> Column:
    """Logarithm of k! as a sum of logarithms."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.ln(i.cast("double")))
