"""Weights of a past row relative to the latest one, as Columns.

``weight(t, s, x, y)``: times and value columns of the latest and of the past row. A kernel
that depends on neither is marked ``constant``, and rolling operators then use the built-in
frame aggregates. ``decimals`` is set where every weight is a decimal number of so many places,
whose sums are then taken without rounding.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Weights below 10^12 with up to so many places are summed as decimals.
MOST_DECIMALS = 12


class Kernel:
    constant = False
    decimals: int | None = None

    def weight(self, t: Column, s: Column, x: Sequence[Column], y: Sequence[Column]) -> Column:
        raise NotImplementedError


class Constant(Kernel):
    constant = True

    def weight(self, t, s, x, y):
        return F.lit(1.0)


class Instantaneous(Kernel):
    """1 at the same time, else 0."""

    def weight(self, t, s, x, y):
        return F.when(t == s, 1.0).otherwise(0.0)


class Exponential(Kernel):
    def __init__(self, timescale: float):
        self.timescale = timescale

    def weight(self, t, s, x, y):
        return F.exp((s - t) / self.timescale)


class Periodic(Kernel):
    def __init__(self, timescale: float):
        self.timescale = timescale

    def weight(self, t, s, x, y):
        return F.exp(-2.0 * F.pow(F.sin((t - s) / 2.0), 2.0) / self.timescale**2)


class Binned(Kernel):
    """A weight per bin of age; an age beyond the bins is an error."""

    def __init__(self, values: Sequence[float], stepsize: float):
        self.values, self.stepsize = list(values), stepsize
        written = [Decimal(repr(float(v))) for v in self.values]
        if all(d.is_finite() and abs(d) < 10**12 for d in written):
            places = max((-d.normalize().as_tuple().exponent for d in written), default=0)
            self.decimals = max(0, places) if places <= MOST_DECIMALS else None

    def weight(self, t, s, x, y):
        return F.element_at(F.array(*[F.lit(float(v)) for v in self.values]), F.floor((t - s) / self.stepsize).cast("int") + 1)


class _State(Kernel):
    def __init__(self, matrix: Sequence[float]):
        n = int(round(len(matrix) ** 0.5))
        m = np.array(matrix, float).reshape(n, n)
        np.linalg.cholesky(m)  # must be positive definite
        self.n, self.inverse, self.det = n, np.linalg.inv(m), float(np.linalg.det(m))

    def form(self, x, y):
        d = [a - b for a, b in zip(x, y, strict=True)]
        total = F.lit(0.0)
        for i in range(self.n):
            for j in range(i, self.n):
                total = total + float(self.inverse[i, j] * (1 if i == j else 2)) * d[i] * d[j]
        return total


class GaussianState(_State):
    """exp(-d' C^-1 d / 2) / det C, of the difference of the states."""

    def weight(self, t, s, x, y):
        return F.exp(-0.5 * self.form(x, y)) / self.det


class TDistributionState(_State):
    """(1 + d' S^-1 d / v)^(-(k + v) / 2) / det S."""

    def __init__(self, matrix: Sequence[float], dof: float):
        super().__init__(matrix)
        self.dof = dof

    def weight(self, t, s, x, y):
        return F.pow(1.0 + self.form(x, y) / self.dof, F.lit(-0.5 * (self.n + self.dof))) / self.det


class Product(Kernel):
    def __init__(self, a: Kernel, b: Kernel):
        self.a, self.b, self.constant = a, b, a.constant and b.constant

    def weight(self, t, s, x, y):
        return self.a.weight(t, s, x, y) * self.b.weight(t, s, x, y)


KERNELS = {
    "constant": Constant, "instantaneous": Instantaneous, "exponential": Exponential, "periodic": Periodic,
    "binned": Binned, "gaussian_state": GaussianState, "t_distribution_state": TDistributionState, "product": Product,
}
