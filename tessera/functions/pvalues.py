"""P values of aggregated rows. Each function takes one row's statistics, never a sample."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return total * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def two_sided_t(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def pearson(r: float, n: float) -> float | None:
    """Two-sided p of a correlation over n pairs, with n - 2 degrees of freedom; none below three pairs."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    return 0.0 if abs(r) >= 1 else two_sided_t(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def _signed_ranks(plus: float, n: int, ties: float) -> tuple[float, float]:
    """P(W <= plus) and P(W >= plus) of the signed-rank sum of n differences.

    ties is the sum of m^3 - m over groups of m equal sizes. Up to 50 differences without ties the distribution is
    exact, else normal with the tie correction.
    """
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return sum(ways[: int(plus) + 1]) / 2**n, sum(ways[int(plus) :]) / 2**n
    spread = math.sqrt(max(n * (n + 1) * (2 * n + 1) / 24 - ties / 48, 0.0))
    z = (plus - n * (n + 1) / 4) / spread / math.sqrt(2) if spread else 0.0
    return (math.erfc(-z) / 2, math.erfc(z) / 2) if spread else (1.0, 1.0)


def wilcoxon(plus: float, n: float, ties: float) -> float | None:
    """Two-sided p of the signed-rank sum of the positive differences among n that are not zero."""
    return None if plus is None or not n else min(1.0, 2 * min(_signed_ranks(plus, int(n), ties)))


def wilcoxon_less(plus: float, n: float, ties: float) -> float | None:
    """One-sided p: how likely the positive differences weigh so little by chance."""
    return None if plus is None or not n else _signed_ranks(plus, int(n), ties)[0]


def wilcoxon_greater(plus: float, n: float, ties: float) -> float | None:
    """One-sided p: how likely the positive differences weigh so much by chance."""
    return None if plus is None or not n else _signed_ranks(plus, int(n), ties)[1]


def sign(positive: float, n: float) -> float | None:
    """Two-sided p of a sign test."""
    if not n:
        return None
    k, n = int(min(positive, n - positive)), int(n)
    half = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * sum(map(math.exp, half)))


def column(of, *columns):
    """One of the functions above over columns of aggregated rows."""

    @F.pandas_udf("double")
    def run(*parts: pd.Series) -> pd.Series:
        clean = lambda v: None if v is None or v != v else float(v)
        return pd.Series([of(*map(clean, row)) for row in zip(*parts, strict=True)], dtype="float64")

    return run(*(F.col(c).cast("double") if isinstance(c, str) else c for c in columns))
