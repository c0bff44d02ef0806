"""Kernel-weighted rolling mean, variance and covariance.

The frame is the latest row and ``depth`` rows before it. A row has a value from step
``depth`` on, and never at step 0; before that it has ``default``. With a constant kernel the
built-in frame aggregates run; other kernels read lagged columns of the one window when the
frame is short, which keeps the weights in generated code, and fold the frame's array beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..series import ID, STEP, TIME, by_step, frame
from .kernels import Constant, Instantaneous, Kernel

#: Up to this depth lagged columns are used.
UNROLLED = 24


def warm(depth: int, value: Column, default: float | Column = 0.0) -> Column:
    return F.when(F.col(STEP) >= max(depth, 1), value).otherwise(default)


def _lagged(df: DataFrame, cols: Sequence[str], depth: int) -> DataFrame:
    """Columns __c_i: column c, i rows back."""
    w = by_step()
    return df.select("*", *[F.lag(c, i).over(w).alias(f"__{c}_{i}") for c in dict.fromkeys([TIME, *cols]) for i in range(1, depth + 1)])


def frame_sums(
    df: DataFrame, cols: Sequence[str], depth: int, kernel: Kernel, terms: dict[str, Callable[[int | Column, Callable[[str], Column]], Column]], state: Sequence[str] | None = None
) -> DataFrame:
    """Adds ``__w``, the sum of weights, and for each term the weighted sum over the frame.

    A term is given how many rows back it is and a function from a column's name to its value
    there, and returns what is weighted.
    """
    state = list(state if state is not None else cols)
    names = list(dict.fromkeys([*cols, *state]))
    if depth <= UNROLLED:
        out, have = _lagged(df, names, depth), lambda i: lambda c: F.col(c) if i == 0 else F.col(f"__{c}_{i}")
        weights = [kernel.weight(F.col(TIME), have(i)(TIME), [F.col(c) for c in state], [have(i)(c) for c in state]) for i in range(depth + 1)]
        add = lambda xs: sum(xs[1:], xs[0])
        out = out.select(*df.columns, *[w.alias(f"__w{i}") for i, w in enumerate(weights)], *[c for c in out.columns if c not in df.columns])
        sums = {k: add([F.col(f"__w{i}") * f(i, have(i)) for i in range(depth + 1)]) for k, f in terms.items()}
        return out.select(*df.columns, add([F.col(f"__w{i}") for i in range(depth + 1)]).alias("__w"), *[v.alias(k) for k, v in sums.items()])
    rows = F.collect_list(F.struct(F.lit(0).alias("__n"), F.col(TIME), *names)).over(frame(depth))
    out = df.withColumn("__h", F.reverse(rows))

    def fold(f):
        weighted = F.transform("__h", lambda r, i: kernel.weight(F.col(TIME), r[TIME], [F.col(c) for c in state], [r[c] for c in state]) * f(i, lambda c: r[c]))
        return F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b)

    return out.select(*df.columns, fold(lambda i, at: F.lit(1.0)).alias("__w"), *[fold(f).alias(k) for k, f in terms.items()])


def rolling_mean(
    df: DataFrame, cols: Sequence[str], depth: int, kernel: Kernel | None = None, *, function: str = "data_values", discount: float = 1.0,
    normalise: bool = True, subtract: float = 0.0, default: float = 0.0, suffix: str = "_mean", others: Sequence[str] = (),
) -> DataFrame:
    """Adds <col>_mean: the weighted sum of the function's values over the sum of weights less
    ``subtract``, or the sum itself. Functions: unit_value, data_values, data_values_variance
    (squared distance from the frame's mean), other_values, past_discounted_data_values and
    past_discounted_other_values (discount to the power of the rows back)."""
    kernel = kernel or Instantaneous()
    source = list(others) if "other" in function else list(cols)
    if isinstance(kernel, Constant) and function == "data_values" and normalise and not subtract:
        return df.select("*", *[warm(depth, F.avg(c).over(frame(depth)), default).alias(c + suffix) for c in cols])
    if function == "data_values_variance":
        return rolling_variance(df, cols, depth, kernel, default=default, suffix=suffix, subtract=subtract)
    shape = {
        "unit_value": lambda c: lambda i, at: F.lit(1.0),
        "data_values": lambda c: lambda i, at: at(c),
        "other_values": lambda c: lambda i, at: at(c),
        "past_discounted_data_values": lambda c: lambda i, at: _power(discount, i) * at(c),
        "past_discounted_other_values": lambda c: lambda i, at: _power(discount, i) * at(c),
    }[function]
    out = frame_sums(df, source, depth, kernel, {f"__s_{c}": shape(c) for c in source}, cols)
    total = F.col("__w") - subtract
    done = [warm(depth, ieee.divide(F.col(f"__s_{c}"), total) if normalise else F.col(f"__s_{c}"), default).alias(c + suffix) for c in source]
    return out.select(*df.columns, *done)


def _power(g: float, i) -> Column:
    return F.lit(float(g) ** i) if isinstance(i, int) else F.pow(F.lit(float(g)), i)


def rolling_variance(df: DataFrame, cols: Sequence[str], depth: int, kernel: Kernel | None = None, *, default: float = 0.0, suffix: str = "_var", subtract: float = 1.0) -> DataFrame:
    """Adds <col>_var: weighted squared distance from the frame's mean over the weights less 1."""
    kernel = kernel or Instantaneous()
    if isinstance(kernel, Constant) and subtract == 1.0:
        return df.select("*", *[warm(depth, F.var_samp(c).over(frame(depth)), default).alias(c + suffix) for c in cols])
    terms = {f"__s_{c}": (lambda c: lambda i, at: at(c))(c) for c in cols}
    terms |= {f"__q_{c}": (lambda c: lambda i, at: (at(c) - F.col(c)) * (at(c) - F.col(c)))(c) for c in cols}
    out = frame_sums(df, cols, depth, kernel, terms)
    # about the latest value: sum w (x - m)^2 = sum w (x - x0)^2 - W (m - x0)^2
    done = []
    for c in cols:
        mean = ieee.divide(F.col(f"__s_{c}"), F.col("__w"))
        spread = F.col(f"__q_{c}") - F.col("__w") * (mean - F.col(c)) * (mean - F.col(c))
        done.append(warm(depth, ieee.divide(spread, F.col("__w") - subtract), default).alias(c + suffix))
    return out.select(*df.columns, *done)


def rolling_covariance(df: DataFrame, cols: Sequence[str], depth: int, kernel: Kernel | None = None, *, default: float = 0.0) -> DataFrame:
    """Adds cov_i_j for all i, j: the upper triangle holds values, below it is zero."""
    kernel, n = kernel or Instantaneous(), len(cols)
    zero = F.lit(0.0)
    if isinstance(kernel, Constant):
        pick = lambda i, j: F.covar_samp(cols[i], cols[j]).over(frame(depth))
        return df.select("*", *[(warm(depth, pick(i, j), default) if i <= j else zero).alias(f"cov_{i}_{j}") for i in range(n) for j in range(n)])
    terms = {f"__s_{c}": (lambda c: lambda i, at: at(c) - F.col(c))(c) for c in cols}
    for i in range(n):
        for j in range(i, n):
            a, b = cols[i], cols[j]
            terms[f"__q_{i}_{j}"] = (lambda a, b: lambda k, at: (at(a) - F.col(a)) * (at(b) - F.col(b)))(a, b)
    out = frame_sums(df, cols, depth, kernel, terms)
    done = []
    for i in range(n):
        for j in range(n):
            if i > j:
                done.append(zero.alias(f"cov_{i}_{j}"))
                continue
            cross = ieee.divide(F.col(f"__s_{cols[i]}") * F.col(f"__s_{cols[j]}"), F.col("__w"))
            done.append(warm(depth, ieee.divide(F.col(f"__q_{i}_{j}") - cross, F.col("__w") - 1.0), default).alias(f"cov_{i}_{j}"))
    return out.select(*df.columns, *done)


def rolling_covariance_pairs(df: DataFrame, cols: Sequence[str], depth: int, *, default: float = 0.0) -> DataFrame:
    """Rows (series_id, step, i, j, cov) for all i <= j, with a constant kernel: for states too
    wide for a column a pair. A pair's nulls are left out, as by covar_samp. A task streams its
    series and carries ``depth`` rows on."""
    import numpy as np
    import pyarrow as pa

    n = len(cols)
    first, second = np.triu_indices(n)

    def products(x, ok):  # (windows, n, rows)
        mean = x.sum(2, keepdims=True) / np.maximum(ok.sum(2, keepdims=True), 1)
        x = (x - mean) * ok
        count, part = ok @ ok.swapaxes(1, 2), x @ ok.swapaxes(1, 2)
        with np.errstate(all="ignore"):
            cov = (x @ x.swapaxes(1, 2) - part * part.swapaxes(1, 2) / count) / (count - 1)
        return cov[:, first, second], count[:, first, second] < 2

    def run(batches):
        last, held = (), None
        for b in batches:
            ids, steps, flat = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).flatten()
            x = np.stack([flat.fill_null(0.0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)]).astype("f8").reshape(2, -1, n)
            starts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
            for s, e in zip(starts, [*starts[1:], len(ids)]):
                if last != (ids[s],):
                    last, held = (ids[s],), np.zeros((2, depth, n))
                held = np.concatenate([held, x[:, s:e]], axis=1)
                frames = np.lib.stride_tricks.sliding_window_view(held, depth + 1, axis=1)
                for k in range(s, e, 32):
                    end = min(e, k + 32)
                    cov, none = products(*frames[:, k - s : end - s])
                    cold = (steps[k:end] < max(depth, 1))[:, None]
                    cov, none = np.where(cold, default, cov), none & ~cold
                    rows = pa.array(np.repeat(np.arange(k, end), len(first)))
                    pair = [pa.array(np.tile(p, end - k).astype("i4")) for p in (first, second)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *pair, pa.array(cov.ravel(), mask=none.ravel())], names=[ID, STEP, "i", "j", "cov"])
                held = held[:, held.shape[1] - depth :]

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (ID, STEP)]
    rows = df.select(ID, F.col(STEP), F.array(*[F.col(c).cast("double") for c in cols]).alias("state"))
    return rows.repartition(ID).sortWithinPartitions(ID, STEP).mapInArrow(run, f"{', '.join(kinds)}, i int, j int, cov double")
