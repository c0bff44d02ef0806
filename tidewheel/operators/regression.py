"""Streaming least squares from running sums: cumulative or over the last rows, through the
origin or with an intercept. The datum of step 0 is not used, and row 0 is zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import STEP, by_step


def _over(x: Column, window: int | None) -> Column:
    w = by_step()
    w = w.rowsBetween(Window.unboundedPreceding, 0) if window is None else w.rowsBetween(1 - window, 0)
    return F.coalesce(F.sum(F.when(F.col(STEP) >= 1, x)).over(w), F.lit(0.0))


def ols(df: DataFrame, y: str, x: str, *, intercept: bool = False, window: int | None = None, least_denominator: float = 1e-12) -> DataFrame:
    """Adds the sufficient statistics and alpha (with intercept), beta and sigma2."""
    X, Y = F.col(x), F.col(y)
    sums = {"n": F.lit(1.0), "sx": X, "sy": Y, "sxx": X * X, "sxy": X * Y, "syy": Y * Y}
    out = df.select("*", *[_over(v, window).alias(k) for k, v in sums.items()])
    n, sx, sy, sxx, sxy, syy = (F.col(k) for k in sums)
    if not intercept:
        good = sxx > least_denominator
        beta = F.when(good, F.try_divide(sxy, sxx)).otherwise(0.0)
        out = out.withColumn("beta", beta)
        sse = syy - F.col("beta") * sxy
        sigma2 = F.when(good & (n >= 2), F.greatest(F.lit(0.0), sse) / F.greatest(F.lit(1.0), n - 1)).otherwise(0.0)
        return out.withColumn("sigma2", sigma2).drop("sx", "sy")
    det = n * sxx - sx * sx
    good = (F.abs(det) > least_denominator) & (n >= 2)
    out = out.withColumn("beta", F.when(good, F.try_divide(n * sxy - sx * sy, det)).otherwise(0.0))
    out = out.withColumn("alpha", F.when(n > 0, F.try_divide(sy - F.col("beta") * sx, n)).otherwise(0.0))
    a, b = F.col("alpha"), F.col("beta")
    sse = syy - a * sy - b * sxy
    return out.withColumn("sigma2", F.when(good & (n >= 3), F.greatest(F.lit(0.0), sse) / F.greatest(F.lit(1.0), n - 2)).otherwise(0.0))
