"""Log-likelihoods and their mean gradients as Columns, priors, and posterior moments.

Distributions of independent elements are closed forms in generated code. Full-covariance
normal and t densities take the inverse from the driver and are quadratic forms; the Wishart
density takes Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee, rng
from ..functions.ieee import digamma, log_gamma
from ..series import STEP, by_step

_LOG_2PI = math.log(2 * math.pi)


def _sum(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


class Normal:
    """Of independent elements by variance, or of a vector by covariance."""

    def __init__(self, mean: Sequence, variance: Sequence | None = None, covariance: Sequence[float] | None = None):
        self.mean, self.variance, self.matrix = list(mean), variance, None
        if covariance is not None:
            self.matrix = np.array(covariance, float).reshape(len(self.mean), -1)

    def _inverse(self):
        return np.linalg.inv(self.matrix)

    def loglike(self, x: Sequence[Column]) -> Column:
        d = [a - m for a, m in zip(x, self.mean, strict=True)]
        if self.matrix is None:
            return _sum([-0.5 * (_LOG_2PI + F.ln(F.lit(v) if not isinstance(v, Column) else v) + e * e / v) for e, v in zip(d, self.variance, strict=True)])
        p, n = self._inverse(), len(d)
        form = _sum([float(p[i, j]) * d[i] * d[j] for i in range(n) for j in range(n)])
        return -0.5 * (form + n * _LOG_2PI + float(np.linalg.slogdet(self.matrix)[1]))

    def gradient(self, x: Sequence[Column]) -> list[Column]:
        d = [a - m for a, m in zip(x, self.mean, strict=True)]
        if self.matrix is None:
            return [e / v for e, v in zip(d, self.variance, strict=True)]
        p = self._inverse()
        return [_sum([float(p[i, j]) * d[j] for j in range(len(d))]) for i in range(len(d))]

    def sample(self, seed: int, *keys: Column) -> list[Column]:
        z = [rng.normal(seed, *keys, draw=i) for i in range(len(self.mean))]
        if self.matrix is None:
            return [F.lit(m) + F.sqrt(F.lit(v)) * e if not isinstance(m, Column) else m + F.sqrt(F.lit(v) if not isinstance(v, Column) else v) * e for m, v, e in zip(self.mean, self.variance, z)]
        root = np.linalg.cholesky(self.matrix)
        return [_sum([F.lit(m) if not isinstance(m, Column) else m, *[float(root[i, j]) * z[j] for j in range(i + 1)]]) for i, m in enumerate(self.mean)]


class StudentT:
    def __init__(self, mean: Sequence, scale: Sequence[float], dof: float):
        self.mean, self.dof = list(mean), float(dof)
        self.matrix = np.array(scale, float).reshape(len(self.mean), -1)
        self.inverse = np.linalg.inv(self.matrix)

    def _form(self, d):
        return _sum([float(self.inverse[i, j]) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))])

    def loglike(self, x):
        d, k, v = [a - m for a, m in zip(x, self.mean, strict=True)], len(self.mean), self.dof
        const = math.lgamma((v + k) / 2) - math.lgamma(v / 2) - 0.5 * k * math.log(v * math.pi) - 0.5 * float(np.linalg.slogdet(self.matrix)[1])
        return F.lit(const) - 0.5 * (v + k) * F.log1p(self._form(d) / v)

    def gradient(self, x):
        """Half of the derivative, as a fixed convention; it only scales a learning rate."""
        d, k, v = [a - m for a, m in zip(x, self.mean, strict=True)], len(self.mean), self.dof
        front = 0.5 * (v + k) / (v + self._form(d))
        return [front * _sum([float(self.inverse[i, j]) * d[j] for j in range(k)]) for i in range(k)]


class Gamma:
    """By mean and variance."""

    def __init__(self, mean: Sequence, variance: Sequence):
        self.mean, self.variance = mean, variance

    def loglike(self, x):
        out = []
        for a, m, v in zip(x, self.mean, self.variance, strict=True):
            m, v = F.lit(m), F.lit(v)
            shape, rate = m * m / v, m / v
            out.append(shape * F.ln(rate) - log_gamma(shape) + (shape - 1) * F.ln(a) - rate * a)
        return _sum(out)

    def gradient(self, x):
        return [(a - m) / v for a, m, v in zip(x, self.mean, self.variance, strict=True)]


class Poisson:
    def __init__(self, mean: Sequence):
        self.mean = mean

    def loglike(self, x):
        return _sum([a * F.ln(F.lit(m)) - F.lit(m) - log_gamma(a + 1) for a, m in zip(x, self.mean, strict=True)])

    def gradient(self, x):
        return [a / m - 1 for a, m in zip(x, self.mean, strict=True)]


class NegativeBinomial:
    def __init__(self, mean: Sequence, variance: Sequence):
        self.mean, self.variance = mean, variance

    def loglike(self, x):
        out = []
        for a, m, v in zip(x, self.mean, self.variance, strict=True):
            m, v = F.lit(m), F.lit(v)
            r, p = m * m / (v - m), m / v
            out.append(log_gamma(r + a) - log_gamma(a + 1) - log_gamma(r) + r * F.ln(p) + a * F.ln(1 - p))
        return _sum(out)

    def gradient(self, x):
        out = []
        for a, m, v in zip(x, self.mean, self.variance, strict=True):
            r = m * m / (v - m)
            out.append(a / m - (a + r) / (r + m))
        return out


class Beta:
    def __init__(self, alpha: Sequence | None = None, beta: Sequence | None = None, mean: Sequence | None = None, variance: Sequence | None = None):
        if alpha is None:
            f = [m * (1 - m) / v - 1 for m, v in zip(mean, variance, strict=True)]
            alpha, beta = [m * g for m, g in zip(mean, f)], [(1 - m) * g for m, g in zip(mean, f)]
        self.alpha, self.beta = alpha, beta

    def loglike(self, x):
        out = []
        for v, a, b in zip(x, self.alpha, self.beta, strict=True):
            a, b = F.lit(a), F.lit(b)
            out.append((a - 1) * F.ln(v) + (b - 1) * F.log1p(-v) - log_gamma(a) - log_gamma(b) + log_gamma(a + b))
        return _sum(out)

    def gradient(self, x):
        out = []
        for v, a, b in zip(x, self.alpha, self.beta, strict=True):
            a, b = F.lit(a), F.lit(b)
            out.append((a + b) * (F.ln(v / (1 - v)) + digamma(b) - digamma(a)))
        return out


def wishart_loglike(x: np.ndarray, scale: np.ndarray, dof: float) -> np.ndarray:
    """Of a matrix, or of each matrix of a stack."""
    k = len(scale)
    logdet = lambda m: np.linalg.slogdet(m)[1]
    multi = k * (k - 1) / 4 * math.log(math.pi) + sum(math.lgamma((dof - i) / 2) for i in range(k))
    trace = np.einsum("ij,...ji->...", np.linalg.inv(scale), x)
    return 0.5 * (dof - k - 1) * logdet(x) - 0.5 * trace - 0.5 * dof * k * math.log(2) - 0.5 * dof * logdet(scale) - multi


class Wishart:
    """Of a flattened matrix column."""

    def __init__(self, scale: Sequence[float], dof: float):
        n = int(round(len(scale) ** 0.5))
        self.scale, self.dof = np.array(scale, float).reshape(n, n), float(dof)

    def loglike(self, x: Column) -> Column:
        import pandas as pd

        scale, dof = self.scale, self.dof
        def run(v):
            have = v.notna()
            out = pd.Series(np.nan, v.index)
            if have.any():
                out[have] = wishart_loglike(np.stack(v[have].to_list()).astype(float).reshape(-1, *scale.shape), scale, dof)
            return out

        return F.pandas_udf(run, "double")(x)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        inv = np.linalg.inv(self.scale)
        return 0.5 * inv @ x @ inv - 0.5 * self.dof * inv


def data_comparison(df: DataFrame, likelihood, cols: Sequence[str], *, cumulative: bool = False, burn_in: int = 0, out: str = "loglike") -> DataFrame:
    """Adds the log-likelihood of each row from ``burn_in`` on (0 before), or its running sum."""
    ll = F.when(F.col(STEP) >= max(burn_in, 1), likelihood.loglike([F.col(c) for c in cols])).otherwise(0.0)
    df = df.withColumn(out, ll)
    return df.withColumn(out, F.sum(out).over(by_step().rowsBetween(Window.unboundedPreceding, 0))) if cumulative else df


def rolling_loglike(df: DataFrame, likelihood, cols: Sequence[str], depth: int, out: str = "loglike") -> DataFrame:
    """Adds the log-likelihood of the latest ``depth`` rows under one set of parameters."""
    df = df.withColumn("__l", likelihood.loglike([F.col(c) for c in cols]))
    total = F.sum("__l").over(by_step().rowsBetween(1 - depth, 0))
    return df.withColumn(out, F.when(F.col(STEP) >= depth - 1, total).otherwise(0.0)).drop("__l")


def data_comparison_gradient(df: DataFrame, likelihood, cols: Sequence[str], depth: int) -> DataFrame:
    """Adds grad_i: the mean gradient over the latest ``depth`` rows."""
    g = likelihood.gradient([F.col(c) for c in cols])
    w = by_step().rowsBetween(1 - depth, 0)
    df = df.select("*", *[e.alias(f"__g{i}") for i, e in enumerate(g)])
    return df.select("*", *[F.avg(f"__g{i}").over(w).alias(f"grad_{i}") for i in range(len(g))]).drop(*[f"__g{i}" for i in range(len(g))])


# --- posterior --------------------------------------------------------------------------


def log_sum_exp(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: ln of the sum of exponentials, shifted by the maximum."""
    top = F.max(col).over(Window.partitionBy(*keys)) if keys else None
    if keys:
        return df.withColumn("__m", top).groupBy(*keys).agg((F.max("__m") + F.ln(F.sum(F.exp(F.col(col) - F.col("__m"))))).alias("log_sum_exp"))
    m = df.agg(F.max(col)).first()[0]
    if m is None:
        return df.agg(F.lit(None).cast("double").alias("log_sum_exp"))
    return df.agg((F.lit(m) + F.ln(F.sum(F.exp(F.col(col) - m)))).alias("log_sum_exp"))


def posterior_moments(df: DataFrame, params: Sequence[str], loglike: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: weighted means mean_i, covariances cov_i_j, and log_marginal, by weights
    proportional to exp(loglike). Two pre-aggregated passes: the maximum, then the sums."""
    top = df.groupBy(*keys).agg(F.max(loglike).alias("__m"))
    joined = df.join(top, list(keys)) if keys else df.withColumn("__m", F.lit(top.first()[0]))
    w = F.exp(F.col(loglike) - F.col("__m"))
    # sums about a key's plain mean keep the second moments from cancelling
    centre = joined.groupBy(*keys, "__m").agg(*[F.avg(p).alias(f"__c{i}") for i, p in enumerate(params)])
    joined = joined.join(centre.drop("__m"), list(keys)) if keys else joined.select("*", *[F.lit(v).alias(f"__c{i}") for i, v in enumerate(centre.drop("__m").first())])
    d = [F.col(p) - F.col(f"__c{i}") for i, p in enumerate(params)]
    n = len(params)
    sums = [F.sum(w).alias("__w"), F.count(F.lit(1)).alias("__n"), F.max("__m").alias("__top")]
    sums += [F.sum(w * d[i]).alias(f"__s{i}") for i in range(n)] + [F.max(f"__c{i}").alias(f"__c{i}") for i in range(n)]
    sums += [F.sum(w * d[i] * d[j]).alias(f"__q{i}_{j}") for i in range(n) for j in range(i, n)]
    a = joined.groupBy(*keys).agg(*sums)
    mean = [F.col(f"__s{i}") / F.col("__w") for i in range(n)]
    cov = {(i, j): F.col(f"__q{i}_{j}") / F.col("__w") - mean[i] * mean[j] for i in range(n) for j in range(i, n)}
    return a.select(
        *keys, *[(F.col(f"__c{i}") + mean[i]).alias(f"mean_{i}") for i in range(n)],
        *[cov[min(i, j), max(i, j)].alias(f"cov_{i}_{j}") for i in range(n) for j in range(n)],
        (F.col("__top") + F.ln("__w") - F.ln("__n")).alias("log_marginal"),
    )


def weighted_quantiles(df: DataFrame, value: str, weight: str, ps: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Per key and p: the least value whose share of the weight up to it reaches p."""
    per = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))  # equal values together
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    share = per.withColumn("__c", F.sum("__w").over(w)).withColumn("__t", F.sum("__w").over(Window.partitionBy(*keys)))
    aggs = [F.min(F.when(F.col("__c") >= F.lit(p) * F.col("__t") * (1 - 1e-12), F.col(value))).alias(f"q{i}") for i, p in enumerate(ps)]
    return share.groupBy(*keys).agg(*aggs)


def posterior_log_normalisation(df: DataFrame, loglikes: Sequence[str], depth: int, discount: float, out: str = "log_norm") -> DataFrame:
    """Adds the log of the sum of exponentials over the columns and over ``depth`` rows, each
    row back discounted."""
    top = F.greatest(*loglikes) if len(loglikes) > 1 else F.col(loglikes[0])
    df = df.withColumn("__r", top + F.ln(_sum([F.exp(F.col(c) - top) for c in loglikes])))
    rows = F.transform(F.reverse(F.collect_list("__r").over(by_step().rowsBetween(1 - depth, 0))), lambda x, i: x + i * math.log(discount))
    df = df.withColumn("__h", rows).withColumn("__m", F.array_max("__h"))
    total = F.col("__m") + F.ln(F.aggregate("__h", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__m"))))
    return df.withColumn(out, total).drop("__r", "__h", "__m")


class Prior:
    """uniform(low, high), truncated_normal(mean, sd, low, high), half_normal(sd), log_normal(mu, sd).
    The truncated density is not normalised."""

    def __init__(self, kind: str, *params: float):
        self.kind, self.params = kind, params

    def sample(self, g: np.random.Generator) -> float:
        p = self.params
        if self.kind == "uniform":
            return g.uniform(*p)
        if self.kind == "half_normal":
            return abs(g.normal(0, p[0]))
        if self.kind == "log_normal":
            return math.exp(g.normal(*p))
        while True:
            if p[2] <= (x := g.normal(p[0], p[1])) <= p[3]:
                return x

    def inside(self, x: float) -> bool:
        if self.kind == "uniform":
            return self.params[0] <= x <= self.params[1]
        if self.kind == "truncated_normal":
            return self.params[2] <= x <= self.params[3]
        return x >= 0 if self.kind == "half_normal" else x > 0

    def logpdf(self, x: float) -> float:
        if not self.inside(x):
            return -math.inf
        p = self.params
        norm = lambda z, s: -0.5 * (z / s) ** 2 - math.log(s) - 0.5 * _LOG_2PI
        if self.kind == "uniform":
            return -math.log(p[1] - p[0])
        if self.kind == "half_normal":
            return math.log(2) + norm(x, p[0])
        if self.kind == "log_normal":
            return norm(math.log(x) - p[0], p[1]) - math.log(x)
        return norm(x - p[0], p[1])

    def variance(self) -> float:
        if self.kind == "uniform":
            return (self.params[1] - self.params[0]) ** 2 / 12
        return {"truncated_normal": lambda p: p[1], "half_normal": lambda p: p[0], "log_normal": lambda p: p[1]}[self.kind](self.params) ** 2
