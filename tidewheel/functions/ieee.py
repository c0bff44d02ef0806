"""Double arithmetic that behaves as hardware does where SQL raises or gives null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def divide(a: Column, b: Column) -> Column:
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(F.ln(x))


def least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b))


def equal(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def less(a: Column, b: Column) -> Column:
    """SQL puts NaN above everything; hardware compares it to nothing."""
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


#: Bernoulli numbers over 2k(2k-1), the coefficients of Stirling's series.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_SHIFT = 10


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0 by Stirling's series ten above, within about 1e-13."""
    x = x.cast("double")
    y = x + _SHIFT
    series = F.lit(0.0)
    for c in reversed(_STIRLING):
        series = series / (y * y) + c
    product = x
    for k in range(1, _SHIFT):
        product = product * (x + k)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series / y - F.ln(product)


def digamma(x: Column) -> Column:
    """ψ(x) for x > 0, by its asymptotic series ten above."""
    x = x.cast("double")
    y = x + _SHIFT
    series = F.lit(0.0)
    for c in reversed((1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)):
        series = (series + c) / (y * y)
    low = F.lit(0.0)
    for k in range(_SHIFT):
        low = low + 1 / (x + k)
    return F.ln(y) - 1 / (2 * y) - series - low
