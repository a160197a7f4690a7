"""Column expressions that settle null, zero and rounding rules in one place."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Z975 = 1.959963984540054
#: Degrees of freedom up to which the t quantile is taken from exact values.
EXACT_DF = 200


def safe_div(a: Column, b: Column) -> Column:
    """a / b; 0.0 if b is 0, null if either is null."""
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(0.0))).otherwise(F.try_divide(a, b))


def to_mm(px: Column, ppm: Column) -> Column:
    """Pixels to millimetres; null without a calibration."""
    return F.when(ppm > 0, px / ppm)


def to_mm2(px2: Column, ppm: Column) -> Column:
    return F.when(ppm > 0, px2 / (ppm * ppm))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def fixed(x: Column, places: int = 2) -> Column:
    """Text with so many places, halves to even, no grouping."""
    return F.call_function("format_number", x, F.lit("0" + ("." + "0" * places if places else "")))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are there; null if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def circular_mean(angle: Column) -> Column:
    """Mean direction in degrees."""
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle)))))


def resultant(angle: Column) -> Column:
    """Length of the mean direction's vector, at most 1."""
    return F.least(F.lit(1.0), F.hypot(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle)))))


def circular_std(angle: Column) -> Column:
    """In degrees; 0 for at most one angle, null if directions cancel out."""
    r = resultant(angle)
    return F.when(F.count(angle) <= 1, 0.0).when(r > 0, F.degrees(F.sqrt(F.greatest(F.lit(0.0), -2 * F.ln(r)))))


def t_upper(df: int) -> float:
    """97.5 % quantile of Student's t, by bisection of its closed form for whole degrees of freedom."""

    def inside(t: float) -> float:
        theta = math.atan(t / math.sqrt(df))
        c, s = math.cos(theta), math.sin(theta)
        if df % 2:
            term, total = c, c if df > 1 else 0.0
            for k in range(3, df - 1, 2):
                term *= c * c * (k - 1) / k
                total += term
            return 2 / math.pi * (theta + s * total)
        term = total = 1.0
        for k in range(2, df - 1, 2):
            term *= c * c * (k - 1) / k
            total += term
        return s * total

    low, high = 0.0, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < 0.95 else (low, middle)
    return high


def t_series(df: Column) -> Column:
    """The same by an expansion around the normal quantile; off by less than 1e-9 from 100 degrees on."""
    z = Z975
    return (
        F.lit(z)
        + (z**3 + z) / (4 * df)
        + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df * df * df)
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * df * df * df * df)
    )


@cache
def _exact() -> tuple[float, ...]:
    return tuple(t_upper(k) for k in range(1, EXACT_DF + 1))


def t_quantile(df: Column) -> Column:
    """97.5 % quantile of Student's t for whole degrees of freedom from 1."""
    exact = F.element_at(F.array(*(F.lit(x) for x in _exact())), F.greatest(F.lit(1), F.least(F.lit(EXACT_DF), df)).cast("int"))
    return F.when(df <= EXACT_DF, exact).otherwise(t_series(df.cast("double")))
