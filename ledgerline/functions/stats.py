"""Binomial bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One-sided confidence of every bound.
ALPHA = 0.05


def _beta_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= k) = I(1 - p; n - k, k + 1), the incomplete beta function by its continued fraction (Lentz).

    Memory does not depend on k, and steps grow as the root of n; all rows advance together.
    """
    a, b, x = n - k, k + 1.0, 1 - p
    turn = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side; the other is its complement
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, p, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny, c, live = 1e-300, np.ones(len(x)), np.ones(len(x), dtype=bool)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    value, m = d.copy(), 0
    while live.any() and m < 10_000_000:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            value = np.where(live, value * d * c, value)
        live &= np.abs(d * c - 1) > 1e-15
    return np.where(turn, 1 - front * value, front * value)


@F.pandas_udf(T.DoubleType())
def binomial_cdf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X <= k); null where an argument is. For a sweep's few rows, whatever the number of trials."""
    rows = pd.DataFrame({"k": k, "n": n, "p": p}).astype(float)
    out = pd.Series(float("nan"), index=rows.index, dtype="float64")
    out[rows["k"] >= rows["n"]] = 1.0
    inner = (rows["k"] >= 0) & (rows["k"] < rows["n"]) & (rows["p"] > 0) & (rows["p"] < 1)
    if inner.any():
        out[inner] = _beta_tail(*(rows.loc[inner, c].to_numpy() for c in ("k", "n", "p")))
    out[(rows["p"] <= 0) & (rows["k"] >= 0)] = 1.0
    return out.where(rows.notna().all(axis=1), None)


def within_budget(wrong: Column, n: Column, budget: Column) -> Column:
    """Whether the Clopper-Pearson upper bound on the error rate is within the budget.

    bound <= budget exactly if P(X <= wrong) at the budget is at most ALPHA. Where the rate itself exceeds the budget the
    bound does too.
    """
    possible = (n > 0) & (wrong <= n * budget)
    return F.when(possible, binomial_cdf(F.when(possible, wrong).otherwise(F.lit(0)), n, budget) <= ALPHA).otherwise(F.lit(False))


def upper_bound(wrong: int, n: int) -> float:
    """The Clopper-Pearson upper bound itself, by bisection on the binomial tail."""
    if n <= 0 or wrong >= n:
        return 1.0
    if wrong == 0:
        return 1 - ALPHA ** (1 / n)
    low, high = wrong / n, 1.0
    for _ in range(100):
        p = (low + high) / 2
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(wrong + 1))
        low, high = (p, high) if tail > ALPHA else (low, p)
    return high


@F.pandas_udf(T.DoubleType())
def clopper_pearson(wrong: pd.Series, n: pd.Series) -> pd.Series:
    """The bound for reports: a few rows, so a UDF is fine; decisions use within_budget."""
    return pd.Series([None if pd.isna(k) or pd.isna(m) else upper_bound(int(k), int(m)) for k, m in zip(wrong, n)], dtype="float64")
