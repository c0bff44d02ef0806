"""Ensemble Kalman filter, sequential Monte Carlo, evolution strategies and mean fits."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import stream
from ..series import ID, STEP, folded
from .likelihood import Prior, posterior_moments
from .numeric import log_sum_exp


def enkf_analysis(forecast: np.ndarray, y: np.ndarray, noise: np.ndarray, observed: Sequence[int], inflation: float = 1.0, g: np.random.Generator | None = None) -> np.ndarray:
    """The analysis ensemble (members by dimensions). Without a generator the observation is
    not perturbed."""
    mean = forecast.mean(0)
    ens = mean + (forecast - mean) * np.sqrt(inflation)
    anomalies, n, r = ens - ens.mean(0), len(ens), np.broadcast_to(noise, len(observed))
    seen = anomalies[:, observed]
    gain = np.linalg.solve(seen.T @ seen / (n - 1) + np.diag(r), (anomalies.T @ seen / (n - 1)).T).T
    noise_draws = g.standard_normal((n, len(observed))) * np.sqrt(r) if g is not None else 0.0
    return ens + (np.asarray(y) + noise_draws - ens[:, observed]) @ gain.T


def ensemble_kalman_filter(df: DataFrame, observation: str, *, members: int, persistence: float, process_variance: float, noise: float, inflation: float = 1.0, seed: int = 0) -> DataFrame:
    """Filters a scalar autoregressive state against each series: adds ``filtered`` and ``spread``.
    Series are independent folds; in a series each step needs the one before, and the gain of
    a single observed value is a quotient."""
    inflate, walk, wrong = np.sqrt(inflation), np.sqrt(process_variance), np.sqrt(noise)

    def start(series):
        g = stream(seed, str(series), "enkf")
        x = g.standard_normal(members)

        def fold(step, y):
            nonlocal x
            z = g.standard_normal((2, members))
            x = persistence * x + walk * z[0]
            mean = x.sum() / members
            anomalies = inflate * (x - mean)
            seen = anomalies @ anomalies / (members - 1)
            x = mean + anomalies
            x += seen / (seen + noise) * (y + wrong * z[1] - x)
            mean = x.sum() / members
            off = x - mean
            return mean, (off @ off / (members - 1)) ** 0.5

        return fold

    return folded(df, [observation], start, {"filtered": T.DoubleType(), "spread": T.DoubleType()})


def particle_posterior(params: np.ndarray, loglikes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and log marginal likelihood of weighted particles."""
    total = log_sum_exp(loglikes)
    w = np.exp(loglikes - total) if np.isfinite(total) else np.full(len(loglikes), 1 / len(loglikes))
    mean = w @ params
    d = params - mean
    return mean, (w[:, None] * d).T @ d, total - np.log(len(loglikes))


#: Rounds of draws in which a proposal must come to lie inside the priors' support.
MOST_TRIES = 100_000


def propose(priors: Sequence[Prior], n: int, g: np.random.Generator, posterior: np.ndarray | None) -> np.ndarray:
    """n particles: from the priors, or from the normal of a posterior row [mean | covariance |
    log marginal], its variances kept above a hundredth of the priors', inside their support."""
    d = len(priors)
    if posterior is None:
        return np.array([[p.sample(g) for p in priors] for _ in range(n)])
    mean, cov = posterior[:d], posterior[d : d + d * d].reshape(d, d).copy()
    floor = np.array([0.01 * p.variance() for p in priors])
    cov[np.diag_indices(d)] = np.maximum(np.diag(cov), floor)
    try:
        root = np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        root = np.diag(np.sqrt(np.diag(cov)))
    out: list[np.ndarray] = []
    for _ in range(MOST_TRIES):
        x = mean + g.standard_normal((max(n - len(out), 16), d)) @ root.T
        out += [v for v in x if all(p.inside(y) for p, y in zip(priors, v))]
        if len(out) >= n:
            return np.array(out[:n])
    raise ValueError("the posterior's normal has no mass inside the priors' support")


def run_smc(spark: SparkSession, priors: Sequence[Prior], loglike: Callable[[np.ndarray, np.random.Generator], float], *, particles: int, rounds: int, seed: int = 0) -> DataFrame:
    """Rounds of particles: one row per round with mean_i, cov_i_j and log_marginal.

    A round draws and scores its particles in parallel, each with a generator of its own, and
    only the posterior's moments, a fixed number of values, come back for the next round. A
    score that is not a number counts as impossible.
    """
    names, post, rows = [f"p{i}" for i in range(len(priors))], None, []
    schema = "particle long, " + ", ".join(f"{n} double" for n in names) + ", loglike double"
    for k in range(rounds):

        def score(batches, k=k, post=post):
            for b in batches:
                out = []
                for i in b["id"]:
                    g = stream(seed, k, int(i), "smc")
                    x = propose(priors, 1, g, post)[0]
                    value = float(loglike(x, g))
                    out.append((int(i), *x, value if value == value else -np.inf))
                yield pd.DataFrame(out, columns=["particle", *names, "loglike"])

        got = posterior_moments(spark.range(particles).mapInPandas(score, schema), names, "loglike").first().asDict()
        d = len(names)
        post = np.array([got[f"mean_{i}"] for i in range(d)] + [got[f"cov_{i}_{j}"] for i in range(d) for j in range(d)] + [got["log_marginal"]])
        rows.append((k, *map(float, post)))
    cols = ["round", *[f"mean_{i}" for i in range(d)], *[f"cov_{i}_{j}" for i in range(d) for j in range(d)], "log_marginal"]
    return spark.createDataFrame(rows, cols)


def evolution_strategy(spark: SparkSession, reward: Callable[[np.ndarray], float], mean: Sequence[float], covariance: np.ndarray, *, rounds: int, chains: int = 1, elite: int = 5, learning_rate: float = 0.2, seed: int = 0, floor: float = 1e-6) -> DataFrame:
    """Chains of a strategy that samples one candidate a round, keeps the best ``elite`` and
    moves its mean and covariance towards theirs. One row per chain: mean_i and the best reward."""
    d = len(mean)
    weights = np.log(elite + 0.5) - np.log(np.arange(1, elite + 1))

    def run(batches):
        for b in batches:
            out = []
            for chain in b["id"]:
                g = stream(seed, int(chain), "es")
                m, cov, best = np.array(mean, float), np.array(covariance, float), []
                for _ in range(rounds):
                    x = g.multivariate_normal(m, cov + floor * np.eye(d))
                    best = sorted([*best, (reward(x), tuple(x))], key=lambda r: -r[0])[:elite]
                    w = weights[: len(best)] / weights[: len(best)].sum()
                    top = np.array([r[1] for r in best])
                    centre = w @ top
                    m = (1 - learning_rate) * m + learning_rate * centre
                    e = top - centre
                    cov = (1 - learning_rate) * cov + learning_rate * (w[:, None] * e).T @ e if len(best) >= elite else cov
                out.append((int(chain), *m, best[0][0]))
            yield pd.DataFrame(out, columns=["chain", *[f"mean_{i}" for i in range(d)], "best"])

    return spark.range(chains).repartition(max(1, min(chains, 200))).mapInPandas(run, "chain long, " + ", ".join(f"mean_{i} double" for i in range(d)) + ", best double")


def fit_mean(df: DataFrame, cols: Sequence[str], variance: Sequence[float], depth: int, *, learning_rate: float, descent_steps: int) -> DataFrame:
    """Adds fit_<col>: the mean of a normal fitted to the latest ``depth`` rows by gradient steps,
    each step's fit starting from the last one's, zero before the window is full.

    One row's steps are m <- m + a (x̄ - m), so they keep the fixed share (1 - a)^k of m and add
    the rest of the window's mean; across rows that is a discounted sum."""
    from ..series import by_step
    from .accumulate import discounted_cumulative

    for c, v in zip(cols, variance, strict=True):
        kept = (1 - learning_rate / v) ** descent_steps
        window = F.avg(c).over(by_step().rowsBetween(1 - depth, 0))
        df = df.withColumn(f"fit_{c}", F.when(F.col(STEP) >= depth, (1 - kept) * window).otherwise(0.0))
        df = discounted_cumulative(df, f"fit_{c}", kept).drop(f"fit_{c}").withColumnRenamed(f"fit_{c}_dis", f"fit_{c}")
    return df


def posterior_estimation(df: DataFrame, col: str, noise: float, prior: Prior, *, depth: int, discount: float, seed: int = 0) -> DataFrame:
    """Adds post_mean and post_var of a series' mean: each step draws a parameter around the
    running posterior, scores the latest ``depth`` rows under it, and blends it in by its share
    of the discounted evidence. One sequential chain per series, many series in parallel."""
    half_log, floor = 0.5 * depth * math.log(2 * math.pi * noise), 0.01 * prior.variance()

    def start(series):
        g, window = stream(seed, str(series), "posterior"), deque(maxlen=depth)
        mean, var, past = prior.sample(g), prior.variance(), -math.inf

        def fold(step, x):
            nonlocal mean, var, past
            window.append(x)
            if step >= depth:
                theta = g.normal(mean, math.sqrt(max(var, floor)))
                if prior.inside(theta):
                    loglike = -0.5 * sum((v - theta) ** 2 for v in window) / noise - half_log
                    past = past + math.log(discount)
                    total = float(np.logaddexp(past, loglike))
                    w = math.exp(loglike - total)
                    mean, var, past = (1 - w) * mean + w * theta, (1 - w) * var + w * (theta - mean) ** 2, total
            return mean, var

        return fold

    return folded(df, [col], start, {"post_mean": T.DoubleType(), "post_var": T.DoubleType()})
