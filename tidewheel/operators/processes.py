"""Stochastic generators over (member, lane, step) grids, and recorded event intensities.

Draws are counter-based, so increments are columns of a grid and a path of independent
increments is a running sum: no state travels between tasks. Paths whose step depends on the
state (mean reversion, multiplicative steps, event rates) are folds over a member's
increments, vectorised over lanes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rng
from ..series import ID, STEP, TIME, by_step, folded
from .kernels import Kernel


def grid(spark: SparkSession, members: int, steps: int, dt: float = 1.0, t0: float = 0.0) -> DataFrame:
    """Rows (series_id = member, step, time) for steps 0..steps."""
    n = steps + 1
    return spark.range(members * n).select(F.floor(F.col("id") / n).cast("long").alias(ID), (F.col("id") % n).alias(STEP)).withColumn(TIME, F.lit(t0) + F.col(STEP) * dt)


def _path(df: DataFrame, increments: Sequence[Column], init: Sequence[float]) -> DataFrame:
    w = by_step().rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", *[F.when(F.col(STEP) >= 1, d).otherwise(F.lit(float(x))).alias(f"__d{i}") for i, (d, x) in enumerate(zip(increments, init, strict=True))])
    return df.select(ID, STEP, TIME, *[F.sum(f"__d{i}").over(w).alias(f"x{i}") for i in range(len(init))])


def _keys(lane: int) -> tuple[Column, ...]:
    return F.col(ID), F.col(STEP), F.lit(lane)


def wiener(df: DataFrame, variances: Sequence[float], init: Sequence[float], seed: int, dt: float = 1.0) -> DataFrame:
    return _path(df, [(v * dt) ** 0.5 * rng.normal(seed, *_keys(i)) for i, v in enumerate(variances)], init)


def drift_diffusion(df: DataFrame, drift: Sequence[float], diffusion: Sequence[float], init: Sequence[float], seed: int, dt: float = 1.0) -> DataFrame:
    return _path(df, [F.lit(a * dt) + b * dt**0.5 * rng.normal(seed, *_keys(i)) for i, (a, b) in enumerate(zip(drift, diffusion, strict=True))], init)


def _event(rate: Column | float, dt: float, seed: int, lane: int, draw: int) -> Column:
    """An event in a step, with probability rate / (rate + 1 / dt)."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.when(r > (r + 1 / dt) * rng.uniform(seed, *_keys(lane), draw=draw), 1.0).otherwise(0.0)


def poisson_process(df: DataFrame, rates: Sequence[float], init: Sequence[float], seed: int, dt: float = 1.0) -> DataFrame:
    return _path(df, [_event(r, dt, seed, i, 0) for i, r in enumerate(rates)], init)


def cox_process(df: DataFrame, rate_columns: Sequence[str], init: Sequence[float], seed: int, dt: float = 1.0) -> DataFrame:
    return _path(df, [_event(F.col(c), dt, seed, i, 0) for i, c in enumerate(rate_columns)], init)


def compound_poisson(df: DataFrame, rates: Sequence[float], alphas: Sequence[float], betas: Sequence[float], init: Sequence[float], seed: int, dt: float = 1.0) -> DataFrame:
    jumps = [rng.gamma(F.lit(float(a)), F.lit(float(b)), rng.key(seed, *_keys(i), draw=7)) for i, (a, b) in enumerate(zip(alphas, betas, strict=True))]
    return _path(df, [_event(r, dt, seed, i, 0) * j for i, (r, j) in enumerate(zip(rates, jumps, strict=True))], init)


def drift_jump_diffusion(df: DataFrame, drift, diffusion, rates, alphas, betas, init, seed: int, dt: float = 1.0) -> DataFrame:
    steps = []
    for i, (a, b, r, al, be) in enumerate(zip(drift, diffusion, rates, alphas, betas, strict=True)):
        jump = rng.gamma(F.lit(float(al)), F.lit(float(be)), rng.key(seed, *_keys(i), draw=7))
        steps.append(F.lit(a * dt) + b * dt**0.5 * rng.normal(seed, *_keys(i)) + _event(r, dt, seed, i, 5) * jump)
    return _path(df, steps, init)


def bernoulli_process(df: DataFrame, probabilities: Sequence[float], seed: int) -> DataFrame:
    return df.select("*", *[rng.bernoulli(float(p), seed, *_keys(i)).alias(f"x{i}") for i, p in enumerate(probabilities)])


def binomial_observation(df: DataFrame, observed: Sequence[str], probabilities: Sequence[float], seed: int) -> DataFrame:
    return df.select("*", *[rng.binomial(F.col(c), F.lit(float(p)), rng.key(seed, *_keys(i))).alias(f"{c}_seen") for i, (c, p) in enumerate(zip(observed, probabilities, strict=True))])


def geometric_brownian(df: DataFrame, variances: Sequence[float], init: Sequence[float], seed: int, dt: float = 1.0) -> DataFrame:
    """x *= 1 + sqrt(v dt) Z. The path is a running product: the sum of the factors' log
    sizes, and the parity of those below zero."""
    w = by_step().rowsBetween(Window.unboundedPreceding, 0)
    f = [F.when(F.col(STEP) >= 1, 1.0 + (v * dt) ** 0.5 * rng.normal(seed, *_keys(i))).otherwise(1.0) for i, v in enumerate(variances)]
    df = df.select("*", *[c.alias(f"__f{i}") for i, c in enumerate(f)])
    size = [F.exp(F.sum(F.ln(F.abs(f"__f{i}"))).over(w)) for i in range(len(f))]
    sign = [1.0 - 2.0 * (F.sum(F.when(F.col(f"__f{i}") < 0, 1).otherwise(0)).over(w) % 2) for i in range(len(f))]
    return df.select(ID, STEP, TIME, *[(float(x) * a * b).alias(f"x{i}") for i, (x, a, b) in enumerate(zip(init, size, sign, strict=True))])


def ornstein_uhlenbeck(df: DataFrame, thetas, mus, sigmas, init, seed: int, dt: float = 1.0, exact: bool = False) -> DataFrame:
    """Mean reversion: a linear recurrence, folded by member over its increments."""
    import numpy as np

    th, mu, sg, x0 = (np.array(v, float) for v in (thetas, mus, sigmas, init))
    decay = np.exp(-th * dt) if exact else 1 - th * dt
    with np.errstate(divide="ignore", invalid="ignore"):
        sd = np.where(th == 0, sg * dt**0.5, sg * np.sqrt((1 - np.exp(-2 * th * dt)) / (2 * th))) if exact else sg * dt**0.5
    lanes = range(len(x0))
    rule = [tuple(map(float, v)) for v in zip(mu, decay, np.broadcast_to(sd, x0.shape))]

    def start(series):
        x = [float(v) for v in x0]

        def fold(step, *noise):
            if step:
                x[:] = [m + (v - m) * d + s * e for v, (m, d, s), e in zip(x, rule, noise)]
            return tuple(x)

        return fold

    z = df.select(ID, STEP, TIME, *[rng.normal(seed, *_keys(i)).alias(f"__z{i}") for i in lanes])
    return folded(z, [f"__z{i}" for i in lanes], start, {f"x{i}": T.DoubleType() for i in lanes}).drop(*[f"__z{i}" for i in lanes])


def recorded_intensity(df: DataFrame, background: float, kernel: Kernel, depth: int) -> DataFrame:
    """Adds ``intensity`` of recorded events: the background and the kernel's weight of each
    of the ``depth`` events before."""
    w = by_step()
    total = F.lit(float(background))
    for i in range(1, depth + 1):
        total = total + F.coalesce(kernel.weight(F.col(TIME), F.lag(TIME, i).over(w), [], []), F.lit(0.0))
    return df.withColumn("intensity", total)
