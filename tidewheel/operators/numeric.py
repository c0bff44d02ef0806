"""numpy forms of kernels, likelihoods, regression and the like, for simulated rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .likelihood import Prior, wishart_loglike

_LOG_2PI = math.log(2 * math.pi)


def log_sum_exp(x: np.ndarray) -> float:
    x = np.asarray(x, float)
    if not len(x) or not np.isfinite(m := x.max()):
        return float(x.max()) if len(x) else -math.inf
    return float(m + np.log(np.exp(x - m).sum()))


def kernel(spec: dict | str | None) -> Callable:
    """(context, t, s, now, past) -> weight, from a kernel's specification."""
    spec = {"type": spec} if isinstance(spec, str) else spec or {"type": "instantaneous"}
    kind = spec["type"]
    if kind == "constant":
        return lambda c, t, s, x, y: 1.0
    if kind == "instantaneous":
        return lambda c, t, s, x, y: float(t == s)
    if kind == "exponential":
        return lambda c, t, s, x, y: math.exp((s - t) / c.p("exponential_weighting_timescale")[0])
    if kind == "periodic":
        return lambda c, t, s, x, y: math.exp(-2 * math.sin((t - s) / 2) ** 2 / c.p("periodic_weighting_timescale")[0] ** 2)
    if kind == "binned":
        return lambda c, t, s, x, y: float(c.p("bin_values")[int((t - s) // c.p("bin_stepsize")[0])])
    if kind == "product":
        a, b = kernel(spec.get("kernel_a") or spec["kernels"][0]), kernel(spec.get("kernel_b") or spec["kernels"][1])
        return lambda *v: a(*v) * b(*v)

    def form(m, x, y):
        m = m.reshape(len(x), len(x))
        d = x - y
        return float(d @ np.linalg.solve(m, d)), float(np.linalg.det(m))

    if kind == "gaussian_state":
        def gaussian(c, t, s, x, y):
            q, det = form(c.p("covariance_matrix"), x, y)
            return math.exp(-0.5 * q) / det

        return gaussian
    if kind == "t_distribution_state":
        def student(c, t, s, x, y):
            q, det = form(c.p("scale_matrix"), x, y)
            v = c.p("degrees_of_freedom")[0]
            return (1 + q / v) ** (-0.5 * (len(x) + v)) / det

        return student
    raise ValueError(f"no kernel {kind!r}")


def ols(rows: np.ndarray, intercept: bool, least: float) -> np.ndarray:
    """Sufficient statistics and estimates of pairs (x, y): [Sxx, Sxy, Syy, n, beta, sigma2], or
    with an intercept [n, Sx, Sy, Sxx, Sxy, Syy, alpha, beta, sigma2]."""
    x, y, n = rows[:, 0], rows[:, 1], float(len(rows))
    sx, sy, sxx, sxy, syy = x.sum(), y.sum(), x @ x, x @ y, y @ y
    if not intercept:
        beta = sxy / sxx if sxx > least else 0.0
        s2 = max(0.0, syy - beta * sxy) / (n - 1) if sxx > least and n >= 2 else 0.0
        return np.array([sxx, sxy, syy, n, beta, s2])
    det = n * sxx - sx * sx
    good = abs(det) > least and n >= 2
    beta = (n * sxy - sx * sy) / det if good else 0.0
    alpha = (sy - beta * sx) / n
    s2 = max(0.0, syy - alpha * sy - beta * sxy) / (n - 2) if good and n >= 3 else 0.0
    return np.array([n, sx, sy, sxx, sxy, syy, alpha, beta, s2])


def pushed(c, value: str, partition: str, indices: str) -> np.ndarray:
    """Values to push: given, or of another partition's committed row: those picked, or, if
    that partition is a collection and none are, what it popped last, its first slot."""
    if c.has(value):
        return c.p(value)
    row = c.past(c.partitions(partition)[0])[0]
    return row[c.p(indices).astype(int)] if c.has(indices) else row[: int(c.p("values_state_width")[0])]


def digamma(x: np.ndarray) -> np.ndarray:
    x, low = np.asarray(x, float), 0.0
    for k in range(10):
        low = low + 1 / (x + k)
    y = x + 10
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - low


_lgamma = np.vectorize(math.lgamma, otypes=[float])


class Likelihood:
    """A density with the parameters of the moment: fixed, same-step, or a partition's row."""

    def __init__(self, kind: str, c):
        self.kind, self.c = kind, c
        get = lambda k: c.p(k) if c.has(k) else c.past(c.partitions(f"{k}_partition")[0])[0] if c.partitions(f"{k}_partition") else None
        self.mean, self.variance, self.cov = get("mean"), get("variance"), get("covariance_matrix")
        if kind == "normal" and c.has("default_covariance") and (self.cov is None or c.step < c.p("cov_burn_in_steps", 0.0)[0]):
            self.cov = c.p("default_covariance")
        if self.cov is not None:
            self.cov = self.cov.reshape(len(self.mean), -1)
            self.cov = np.triu(self.cov) + np.triu(self.cov, 1).T
        elif kind in ("normal", "t_distribution"):
            self.cov = np.diag(np.broadcast_to(self.variance, len(self.mean)))
        if kind == "beta":
            if c.has("alpha"):
                self.a, self.b = c.p("alpha"), c.p("beta")
            else:
                f = self.mean * (1 - self.mean) / self.variance - 1
                self.a, self.b = self.mean * f, (1 - self.mean) * f
        if kind in ("wishart", "t_distribution"):
            self.dof = c.p("degrees_of_freedom")[0]
        if kind == "wishart":
            s = c.p("scale_matrix")
            self.scale = s.reshape(int(round(len(s) ** 0.5)), -1)

    def loglike(self, x: np.ndarray) -> float:
        k, m, v = self.kind, self.mean, self.variance
        if k in ("normal", "t_distribution"):
            d, logdet = x - m, np.linalg.slogdet(self.cov)[1]
            q = d @ np.linalg.solve(self.cov, d)
            if k == "normal":
                return float(-0.5 * (q + len(d) * _LOG_2PI + logdet))
            n, nu = len(d), self.dof
            return float(math.lgamma((nu + n) / 2) - math.lgamma(nu / 2) - 0.5 * n * math.log(nu * math.pi) - 0.5 * logdet - 0.5 * (nu + n) * math.log1p(q / nu))
        if k == "poisson":
            return float((x * np.log(m) - m - _lgamma(x + 1)).sum())
        if k == "gamma":
            a, r = m * m / v, m / v
            return float((a * np.log(r) - _lgamma(a) + (a - 1) * np.log(x) - r * x).sum())
        if k == "negative_binomial":
            r, p = m * m / (v - m), m / v
            return float((_lgamma(r + x) - _lgamma(x + 1) - _lgamma(r) + r * np.log(p) + x * np.log1p(-p)).sum())
        if k == "beta":
            return float(((self.a - 1) * np.log(x) + (self.b - 1) * np.log1p(-x) + _lgamma(self.a + self.b) - _lgamma(self.a) - _lgamma(self.b)).sum())
        return float(wishart_loglike(x.reshape(self.scale.shape), self.scale, self.dof))

    def gradient(self, x: np.ndarray) -> np.ndarray:
        k, m, v = self.kind, self.mean, self.variance
        if k == "normal":
            return np.linalg.solve(self.cov, x - m)
        if k == "t_distribution":
            s = np.linalg.solve(self.cov, x - m)
            return 0.5 * (self.dof + len(x)) / (self.dof + (x - m) @ s) * s
        if k == "poisson":
            return x / m - 1
        if k == "gamma":
            return (x - m) / v
        if k == "negative_binomial":
            r = m * m / (v - m)
            return x / m - (x + r) / (r + m)
        if k == "beta":
            return (self.a + self.b) * (np.log(x / (1 - x)) + digamma(self.b) - digamma(self.a))
        inv = np.linalg.inv(self.scale)
        return (0.5 * inv @ x.reshape(inv.shape) @ inv - 0.5 * self.dof * inv).ravel()

    def sample(self, g: np.random.Generator) -> np.ndarray:
        k, m, v = self.kind, self.mean, self.variance
        if k == "normal":
            return g.multivariate_normal(m, self.cov)
        if k == "t_distribution":
            return m + g.multivariate_normal(np.zeros(len(m)), self.cov) / math.sqrt(g.chisquare(self.dof) / self.dof)
        if k == "poisson":
            return g.poisson(m).astype(float)
        if k == "gamma":
            return g.gamma(m * m / v, v / m)
        if k == "negative_binomial":
            return g.negative_binomial(m * m / (v - m), m / v).astype(float)
        if k == "beta":
            return g.beta(self.a, self.b)
        n, root = len(self.scale), np.linalg.cholesky(self.scale)
        a = np.tril(g.standard_normal((n, n)), -1) + np.diag([math.sqrt(g.chisquare(self.dof - i)) for i in range(n)])
        w = root @ a
        return (w @ w.T).ravel()


def likelihood(spec: dict | str) -> Callable:
    kind = spec if isinstance(spec, str) else spec["type"]
    if kind not in ("normal", "t_distribution", "wishart", "beta", "gamma", "poisson", "negative_binomial"):
        raise ValueError(f"no likelihood {kind!r}")
    return lambda c: Likelihood(kind, c)


_PRIOR_FIELDS = {"uniform": ("lower", "upper"), "truncated_normal": ("mean", "std", "lower", "upper"), "half_normal": ("std",), "log_normal": ("mu", "sigma")}


def priors(specs: list) -> list[Prior]:
    out = []
    for s in specs:
        if isinstance(s, Prior):
            out.append(s)
        else:
            values = s.get("params") or [s[f] for f in _PRIOR_FIELDS[s["type"]]]
            out.append(Prior(s["type"], *map(float, values)))
    return out
