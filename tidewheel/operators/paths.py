"""Many paths of one model at once: a task advances a block of paths as vectors.

Paths share nothing, so blocks are the unit of parallelism, and a task holds one block's
state, not its history: only the steps asked for leave it. A block's draws depend on the seed
and the block alone, so a lost task gives the same paths again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Steps drawn at once; bounds a task's memory at chunk * block doubles.
CHUNK = 50


def _gbm(x, n, g, dt, variance):
    z = g.standard_normal((n, *x[0].shape))
    z *= (variance * dt) ** 0.5
    z += 1.0
    return [x[0] * np.multiply.reduce(z, axis=0)]


def _ou(x, n, g, dt, theta, mu, sigma):
    z = g.standard_normal((n, *x[0].shape))
    z *= sigma * dt**0.5
    z += theta * mu * dt
    y, keep = x[0], 1 - theta * dt
    for row in z:
        y *= keep
        y += row
    return [y]


def _compound_poisson(x, n, g, dt, rate, alpha, beta):
    hit = g.random((n, *x[0].shape), dtype="f4") < rate / (rate + 1 / dt)
    jumps = np.zeros(hit.shape)
    jumps[hit] = g.standard_gamma(alpha, int(hit.sum())) / beta
    return [x[0] + jumps.sum(0)]


def _coupled_ou(x, n, g, dt, theta, mu, sigma):
    """Each component reverts to the one before it at the same step; the first to ``mu``."""
    s, k = sigma * dt**0.5, theta * dt
    z = g.standard_normal((n, len(x), *x[0].shape))
    z *= s
    for row in z:
        to = mu
        for y, e in zip(x, row):
            y += k * (to - y)
            y += e
            to = y
    return x


def _branch(x, n, g, dt, theta, sigma, threshold, decay, work):
    """A driver, and a responder that decays and does ``work`` rounds where the driver is high."""
    z = g.standard_normal((n, *x[0].shape))
    z *= sigma * dt**0.5
    d, r = x
    for row in z:
        d *= 1 - theta * dt
        d += row
        r *= decay
        at = np.flatnonzero(d > threshold)
        if len(at):
            v = d[at].copy()
            for _ in range(work):
                np.sin(v, out=v)
                v += 0.5
            r[at] += v
    return [d, r]


MODELS: dict[str, tuple[int, Callable, dict]] = {
    "gbm": (1, _gbm, {"variance": 0.01}),
    "ou": (1, _ou, {"theta": 0.5, "mu": 1.0, "sigma": 0.2}),
    "compound_poisson": (1, _compound_poisson, {"rate": 0.1, "alpha": 2.0, "beta": 4.0}),
    "coupled_ou": (4, _coupled_ou, {"theta": 0.5, "mu": 1.0, "sigma": 0.2}),
    "branch": (2, _branch, {"theta": 0.5, "sigma": 0.2, "threshold": 0.4, "decay": 0.9, "work": 20}),
}


def paths(spark: SparkSession, model: str, n: int, steps: int, *, init: float = 1.0, dt: float = 0.01, every: int | None = None, seed: int = 0, block: int = 1250, **params) -> DataFrame:
    """Rows (series_id, step, time, x0, ...) of n paths, at each ``every`` steps and at the end."""
    width, advance, defaults = MODELS[model]
    given = {**defaults, **params}
    blocks, every = -(-n // block), every or steps
    names = ["series_id", "step", "time", *[f"x{i}" for i in range(width)]]

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                g = np.random.Generator(np.random.SFC64([seed, k]))
                here = min(block, n - k * block)
                x, ids, done = [np.full(here, init) for _ in range(width)], pa.array(np.arange(k * block, k * block + here)), 0
                while done < steps:
                    go = min(CHUNK, steps - done, every - done % every)
                    x = advance(x, go, g, dt, **given)
                    done += go
                    if done % every == 0 or done == steps:
                        cols = [ids, pa.array(np.full(here, done)), pa.array(np.full(here, done * dt)), *[pa.array(v) for v in x]]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "series_id long, step long, time double, " + ", ".join(f"x{i} double" for i in range(width))
    return spark.range(0, blocks, 1, min(blocks, 100_000)).mapInArrow(run, schema)
