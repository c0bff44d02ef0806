"""Counter-based random columns: the same draw for the same keys, however rows are dealt out.

A uniform is the top 53 bits of a 64-bit hash of (seed, keys..., draw number). Distributions
with a closed inverse or a simple transform stay in generated code; gamma, beta, binomial and
Poisson draws need rejection or splitting, done on whole Arrow batches.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int, *keys: Column, draw: int = 0) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), *keys, F.lit(draw))


def uniform(seed: int, *keys: Column, draw: int = 0) -> Column:
    """In (0, 1)."""
    return (F.shiftrightunsigned(key(seed, *keys, draw=draw), 11).cast("double") + 0.5) * (2.0**-53)


def normal(seed: int, *keys: Column, draw: int = 0) -> Column:
    u, v = uniform(seed, *keys, draw=2 * draw), uniform(seed, *keys, draw=2 * draw + 1)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)


def exponential(rate: Column | float, seed: int, *keys: Column, draw: int = 0) -> Column:
    return -F.ln(uniform(seed, *keys, draw=draw)) / rate


def bernoulli(p: Column | float, seed: int, *keys: Column, draw: int = 0) -> Column:
    return F.when(uniform(seed, *keys, draw=draw) < p, 1.0).otherwise(0.0)


class Draws:
    """Uniform numbers for an array of keys, each with a counter of its own: what a row draws
    depends on its key alone, whatever rows share its batch."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.n = keys.astype(np.int64).view(np.uint64), np.zeros(len(keys), np.uint64)

    def uniform(self, at: np.ndarray) -> np.ndarray:
        """The next number in (0, 1) of the rows ``at``: the counter through a 64-bit mixer."""
        self.n[at] += np.uint64(1)
        z = self.keys[at] + self.n[at] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        return ((z >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53

    def normal(self, at: np.ndarray) -> np.ndarray:
        return np.sqrt(-2 * np.log(self.uniform(at))) * np.cos(2 * math.pi * self.uniform(at))

    def log_gamma(self, alpha: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logarithms of gamma draws of rate 1 for the rows ``at``, by squeezed cubes of normals;
        a shape below 1 is drawn one higher and scaled by a power of a uniform. The logarithm of
        shape 0 is -inf, and a shape that is no number gives none."""
        if (alpha < 0).any():
            raise ValueError("a gamma draw needs a shape of at least 0")
        out = np.where(alpha == 0, -np.inf, np.where(np.isinf(alpha), np.inf, np.nan))
        low = alpha < 1
        d = np.where(low, alpha + 1, alpha) - 1 / 3
        left = np.flatnonzero((alpha > 0) & np.isfinite(alpha))
        while len(left):
            x, u, k = self.normal(at[left]), self.uniform(at[left]), d[left]
            v = (1 + x / np.sqrt(9 * k)) ** 3
            held = v > 0
            log_v = np.log(np.where(held, v, 1.0))
            held &= np.log(u) < 0.5 * x * x + k * (1 - v + log_v)
            out[left[held]] = (np.log(k) + log_v)[held]
            left = left[~held]
        scale = np.flatnonzero(low & (alpha > 0))
        out[scale] += np.log(self.uniform(at[scale])) / alpha[scale]
        return out

    def beta(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        x, y = self.log_gamma(a, at), self.log_gamma(b, at)
        with np.errstate(over="ignore", invalid="ignore"):
            return 1 / (1 + np.exp(y - x))

    def binomial(self, n: np.ndarray, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Successes of n trials. The middle one of n ordered uniforms is a beta draw; on which
        side of it p lies halves the trials that are left, and the last few are counted."""
        if (n < 0).any() or ((p < 0) | (p > 1)).any():
            raise ValueError("a binomial draw needs trials of at least 0 and a probability")
        out, n, p = np.where(np.isnan(n + p), np.nan, 0.0), np.floor(np.where(np.isnan(n + p), 0, n)), p.copy()
        while len(big := np.flatnonzero(n >= 16)):
            a = 1 + np.floor(n[big] / 2)
            b = n[big] + 1 - a
            x = self.beta(a, b, at[big])
            above = x >= p[big]
            out[big] += np.where(above, 0, a)
            n[big] = np.where(above, a, b) - 1
            p[big] = np.clip(np.where(above, p[big] / x, (p[big] - x) / (1 - x)), 0, 1)
        for i in range(int(n.max(initial=0))):
            left = np.flatnonzero(n > i)
            out[left] += self.uniform(at[left]) < p[left]
        return out

    def poisson(self, lam: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Arrivals in a time lam. The time of the m-th is a gamma draw; if it is in, m arrivals
        and the time after it are left, else those before it fall at even chance; a short time
        is counted arrival by arrival."""
        if (lam < 0).any():
            raise ValueError("a poisson draw needs a rate of at least 0")
        out, lam = np.where(np.isnan(lam), np.nan, 0.0), np.nan_to_num(lam, nan=0.0)
        while len(big := np.flatnonzero(lam >= 16)):
            m = np.floor(lam[big] * 0.875)
            x = np.exp(self.log_gamma(m, at[big]))
            inside = x <= lam[big]
            out[big[inside]] += m[inside]
            past = big[~inside]
            out[past] += self.binomial((m - 1)[~inside], lam[past] / x[~inside], at[past])
            lam[big] = np.where(inside, lam[big] - x, 0.0)
        left, t = np.flatnonzero(lam > 0), np.zeros(len(lam))
        while len(left):
            t[left] -= np.log(self.uniform(at[left]))
            left = left[t[left] <= lam[left]]
            out[left] += 1
        return out


def _drawn(draw):
    def run(k: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(draw(Draws(k.to_numpy()), a.to_numpy(float), b.to_numpy(float), np.arange(len(k))))

    return F.pandas_udf(run, "double")


def gamma(alpha: Column, rate: Column, k: Column) -> Column:
    return _drawn(lambda g, a, r, at: np.exp(g.log_gamma(a, at)) / r)(k, alpha, rate)


def beta(a: Column, b: Column, k: Column) -> Column:
    return _drawn(lambda g, x, y, at: g.beta(x, y, at))(k, a, b)


def binomial(n: Column, p: Column, k: Column) -> Column:
    return _drawn(lambda g, x, y, at: g.binomial(x, y, at))(k, n, p)


def poisson(lam: Column, k: Column) -> Column:
    return _drawn(lambda g, x, _, at: g.poisson(x, at))(k, lam, F.lit(0.0))


def stream(*parts: int | str) -> np.random.Generator:
    """A generator of its own for a path of names and numbers (seed, member, partition...), by
    a digest of all of them: long names, and numbers of any size, are told apart."""
    named = "\x1f".join(f"s{len(p)}:{p}" if isinstance(p, str) else f"i{int(p)}" for p in parts)
    words = np.frombuffer(hashlib.sha256(named.encode()).digest(), "<u4")
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(words.tolist())))
