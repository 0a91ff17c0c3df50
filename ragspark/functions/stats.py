"""Closed-form statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Z = 1.96
# fixed values: the polynomial 7.1.26 for the error function
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def wilson(hits, n, z: float = Z) -> Column:
    """(low, high) of a proportion, clamped to [0, 1]; both 0 without trials."""
    hits, n = (F.col(c) if isinstance(c, str) else c for c in (hits, n))
    hits, n = hits.cast("double"), n.cast("double")
    p = hits / F.nullif(n, F.lit(0.0))
    base = 1 + z * z / n
    centre, reach = (p + z * z / (2 * n)) / base, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    low, high = F.greatest(F.lit(0.0), centre - reach), F.least(F.lit(1.0), centre + reach)
    some = n > 0
    return F.struct(F.when(some, low).otherwise(0.0).alias("low"), F.when(some, high).otherwise(0.0).alias("high"))


def erfc(x: Column) -> Column:
    """For x >= 0."""
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def mcnemar(b: Column, c: Column) -> Column:
    """(statistic, p) with continuity correction; p is 1 without flips."""
    flips = (b + c).cast("double")
    gap = F.greatest(F.abs(b - c).cast("double") - 1, F.lit(0.0))
    chi = F.when(flips > 0, gap * gap / F.nullif(flips, F.lit(0.0))).otherwise(0.0)
    return F.struct(chi.alias("statistic"), F.when(flips > 0, erfc(F.sqrt(chi / 2))).otherwise(1.0).alias("p"))
