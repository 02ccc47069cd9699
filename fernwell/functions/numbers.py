"""Rounding, percentages and statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational Chebyshev fit of erfc (Numerical Recipes), lowest power first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def half_even(c: Column, digits: int) -> Column:
    """Scale, round half to even, scale back."""
    return F.rint(c * 10**digits) / 10**digits


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole with one decimal; null where the whole is null or zero."""
    return F.when(whole != 0, half_even(100.0 * part / whole, 1))


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole != 0, half_even(part / whole, digits))


def erfc(z: Column) -> Column:
    """The complementary error function for z >= 0, within 1.2e-7."""
    t = 1.0 / (1.0 + 0.5 * z)
    total = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        total = F.lit(c) + t * total
    return t * F.exp(-z * z + total)


def two_proportion_p(pct1: Column, n1: Column, pct2: Column, n2: Column) -> Column:
    """Two-sided p-value of the pooled z-test for two percentages; 1 without spread, null where a part is missing or empty."""
    pooled = (pct1 * n1 + pct2 * n2) / (n1 + n2) / 100.0
    spread = F.sqrt(pooled * (1 - pooled) * (1.0 / n1 + 1.0 / n2))
    z = F.abs(pct1 - pct2) / 100.0 / spread
    p = F.when(spread > 0, half_even(erfc(z / math.sqrt(2)), 4)).otherwise(1.0)
    return F.when(pct1.isNotNull() & pct2.isNotNull() & (n1 > 0) & (n2 > 0), p)


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Struct (low, high) of the Wilson interval in per cent; null for n = 0."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(half_even(F.greatest(centre - half, F.lit(0.0)) * 100, 1).alias("low"), half_even(F.least(centre + half, F.lit(1.0)) * 100, 1).alias("high")))


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size < 0.1, "negligible").when(size < 0.3, "weak").when(size < 0.5, "moderate").when(size >= 0.5, "strong")
