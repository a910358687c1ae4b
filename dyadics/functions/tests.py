"""Test statistics of one row."""

from __future__ import annotations

from math import comb, exp, lgamma, log, log1p, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Discordant pairs up to which the tail is summed in whole numbers.
WHOLE_NUMBERS = 1_000
_BLOCK = 4_096


def _stirling_rest(n: int) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def half_tail(n: int, k: int) -> float:
    """Chance of at most ``k`` of ``n`` heads of a fair coin, k <= n / 2.

    The largest term is by its deviance, which does not cancel however large n is; the others follow from it by their
    ratios, downwards until they no longer count: some multiple of the square root of n.
    """
    if n <= WHOLE_NUMBERS:
        return sum(comb(n, i) for i in range(k + 1)) / 2**n
    if k == 0:
        return 0.5**n
    d = (n - 2 * k) / n  # the deviance is n / 2 times (1 - d) log(1 - d) + (1 + d) log(1 + d)
    deviance = k * log1p(-d) + (n - k) * log1p(d)
    term = sqrt(n / (2 * pi * k * (n - k))) * exp(_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - deviance)
    total, weight, i = 1.0, 1.0, k
    while i > 0 and weight > 1e-18 * total:
        steps = np.arange(i, max(i - _BLOCK, 0), -1, dtype=np.float64)
        weights = weight * np.cumprod(steps / (n - steps + 1))
        total, weight, i = total + float(weights.sum()), float(weights[-1]), i - len(steps)
    return term * total


@F.pandas_udf(DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided McNemar p-value of discordant counts; 1 without discordant pairs."""

    def one(x, y):
        if pd.isna(x) or pd.isna(y):
            return None
        n, k = int(x) + int(y), min(int(x), int(y))
        return min(1.0, 2 * half_tail(n, k)) if n else 1.0

    return pd.Series([one(x, y) for x, y in zip(b, c, strict=True)], dtype="float64")


def wald_two(lam: Column, eta: Column, var_lam: Column, var_eta: Column, cov: Column) -> Column:
    """Wald statistic of lambda = eta = 0; its chi-square survival with two degrees is exp(-W / 2)."""
    det = var_lam * var_eta - cov * cov
    return (lam * lam * var_eta - 2 * lam * eta * cov + eta * eta * var_lam) / det


def chi2_log10_survival(x: Column, degrees: int) -> Column:
    """log10 of the survival of chi-square with even ``degrees``: a finite sum, shifted so that it cannot overflow."""
    if degrees % 2:
        raise ValueError("degrees are even")
    half = x / 2
    logs = [half * 0.0]
    for j in range(1, degrees // 2):
        logs.append(logs[-1] + F.log(half / j))
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    total = sum((F.exp(v - top) for v in logs[1:]), F.exp(logs[0] - top))
    return F.when(x <= 0, 0.0).otherwise((top + F.log(total) - half) / F.log(F.lit(10.0)))


def interval_verdict(low: Column, high: Column) -> Column:
    """clear_increase, clear_decrease or no_clear_change, by an interval's place about 0."""
    return F.when(low > 0, "clear_increase").when(high < 0, "clear_decrease").otherwise("no_clear_change")
