"""Streams of rows (series_id, time, value): rolling means, regression and top lists with the
state of each series in the state store, and pushes of finished batches to callers.

A stream has no row frames, so a series keeps the rows its frame needs. Rows that come with a
time at or below the last one are late and dropped, as the model's time must increase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..series import ID, TIME


def _run(df: DataFrame, value: str, columns: str, start, step: Callable) -> DataFrame:
    """``step(state, time, value) -> (state, outputs)`` over each series' rows in time order."""
    kind = df.schema[ID].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, state = (held.get[0], _load(held.get[1])) if held.exists else (float("-inf"), start)
        rows = pd.concat(list(frames)).sort_values(TIME)
        out = []
        for t, v in zip(rows[TIME], rows[value]):
            if t > last:
                state, got = step(state, float(t), float(v))
                out.append((key[0], float(t), *got))
                last = float(t)
        held.update((last, _dump(state)))
        yield pd.DataFrame(out, columns=[ID, TIME, *names])

    return df.groupBy(ID).applyInPandasWithState(run, f"{ID} {kind}, {TIME} double, {columns}", "last double, state string", "append", GroupStateTimeout.NoTimeout)


def _dump(state) -> str:
    import json

    return json.dumps(state)


def _load(text: str):
    import json

    return json.loads(text)


def rolling_mean(df: DataFrame, value: str, depth: int, default: float = 0.0) -> DataFrame:
    """Append mode: each row's mean over itself and ``depth`` rows before it."""

    def step(state, t, v):
        state = [*state, v][-(depth + 1) :]
        return state, (sum(state) / len(state) if len(state) > depth else default,)

    return _run(df, value, "mean double", [], step)


def exponential_mean(df: DataFrame, value: str, depth: int, timescale: float, default: float = 0.0) -> DataFrame:
    import math

    def step(state, t, v):
        state = [*state, [t, v]][-(depth + 1) :]
        w = [math.exp((s - t) / timescale) for s, _ in state]
        return state, (sum(a * x for a, (_, x) in zip(w, state)) / sum(w) if len(state) > depth else default,)

    return _run(df, value, "mean double", [], step)


def ols(df: DataFrame, value: str) -> DataFrame:
    """Cumulative regression of the value on time since the series' first row."""

    def step(state, t, v):
        t0, n, sx, sy, sxx, sxy = state or (t, 0, 0.0, 0.0, 0.0, 0.0)
        x = t - t0
        n, sx, sy, sxx, sxy = n + 1, sx + x, sy + v, sxx + x * x, sxy + x * v
        det = n * sxx - sx * sx
        beta = (n * sxy - sx * sy) / det if n >= 2 and abs(det) > 1e-12 else 0.0
        return (t0, n, sx, sy, sxx, sxy), ((sy - beta * sx) / n, beta)

    return _run(df, value, "alpha double, beta double", None, step)


def running_top(df: DataFrame, value: str, k: int) -> DataFrame:
    def step(state, t, v):
        state = sorted([*state, v], reverse=True)[:k]
        return state, (list(state),)

    return _run(df, value, "top array<double>", [], step)


def push(df: DataFrame, send: Callable[[list[dict]], None], checkpoint: str, delay: str = "0 seconds"):
    """Start a query that hands each finished batch's rows to ``send``, partition by partition."""

    def batch(rows: DataFrame, _id: int) -> None:
        rows.foreachPartition(lambda part: send([r.asDict(recursive=True) for r in part]))

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=delay).start()
