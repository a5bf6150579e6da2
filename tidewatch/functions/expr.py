"""Column builders that the engine's operators share; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def half_up(x: Column, digits: int) -> Column:
    """Rounding half towards plus infinity, as the scoring rules define it."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, halves away from zero."""
    return F.format_string(f"%.{digits}f", F.signum(x) * half_up(F.abs(x), digits))


def signed_percent(x: Column) -> Column:
    """A share as a percentage with one decimal and its sign."""
    return F.concat(F.when(x >= 0, "+").otherwise("-"), fixed(F.abs(x) * 100, 1), F.lit("%"))


def squash(z: Column) -> Column:
    """A signed strength between -1 and 1; what is not finite counts as 0."""
    return F.when(z.isNull() | F.isnan(z), F.lit(0.0)).otherwise(F.tanh(z / 4))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def slope(sxy: Column, sxx: Column) -> Column:
    return safe_div(sxy, sxx)


def correlation(sxy: Column, sxx: Column, syy: Column) -> Column:
    """Null where either side does not vary."""
    return safe_div(sxy, F.sqrt(F.greatest(sxx * syy, F.lit(0.0))))


def median(sample: Column) -> Column:
    """Exact median of an array of doubles; the array is sorted once."""
    n = F.size(sample)
    middle = F.transform(
        F.array(F.array_sort(sample)), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    )[0]
    return F.when(n > 0, middle)


def mad_z(x: Column, centre: Column, sample: Column) -> Column:
    """Robust z: distance from the sample's median ``centre`` in scaled median absolute deviations.

    The centre comes as a column of its own, so that it is not computed anew for each element.
    """
    return safe_div(x - centre, median(F.transform(sample, lambda v: F.abs(v - centre))) * 1.4826)


def severity_rank(score: Column) -> Column:
    """0 NOISE, 1 INFO, 2 WATCH, 3 IMPORTANT, 4 CRITICAL."""
    return F.when(score >= 82, 4).when(score >= 64, 3).when(score >= 40, 2).when(score >= 25, 1).otherwise(0)


SEVERITIES = ["NOISE", "INFO", "WATCH", "IMPORTANT", "CRITICAL"]


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank)
