"""Step-synchronous simulation of partitions, one member a task.

Recorded data go through window operators; this engine is for what reads its own output. A
member's partitions advance together in numpy inside a grouped map, and members, which share
nothing, are Spark's unit of parallelism.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng as rngs
from ..series import ID, STEP, TIME
from . import graph


@dataclass
class Partition:
    name: str
    iteration: dict | Callable
    params: dict[str, Sequence[float]] = field(default_factory=dict)
    params_as_partitions: dict[str, list[str]] = field(default_factory=dict)
    params_from_upstream: dict[str, dict] = field(default_factory=dict)
    init_state_values: Sequence[float] = (0.0,)
    state_history_depth: int = 1
    seed: int = 0


@dataclass
class Clock:
    """constant(stepsize), exponential_distribution(mean, seed) or recorded times."""

    kind: str = "constant"
    stepsize: float = 1.0
    mean: float = 1.0
    seed: int = 0
    times: Sequence[float] = ()


@dataclass
class Settings:
    partitions: list[Partition]
    steps: int | None = 1
    until: float | None = None
    init_time: float = 0.0
    clock: Clock = field(default_factory=Clock)
    record: Callable[[str, int], bool] | None = None

    def __post_init__(self):
        names = [p.name for p in self.partitions]
        if len(set(names)) != len(names):
            raise ValueError("partition names repeat")
        widths = {p.name: len(p.init_state_values) for p in self.partitions}
        for p in self.partitions:
            for k, u in p.params_from_upstream.items():
                if u["upstream"] not in widths:
                    raise ValueError(f"{p.name}: no partition {u['upstream']!r}")
                if any(not 0 <= i < widths[u["upstream"]] for i in u.get("indices") or ()):
                    raise ValueError(f"{p.name}: {k} reads beyond the width of {u['upstream']!r}")
            for ns in p.params_as_partitions.values():
                for n in ns:
                    if n not in widths:
                        raise ValueError(f"{p.name}: no partition {n!r}")


class Context:
    """What a partition sees in a step."""

    def __init__(self, run: "Run", p: Partition):
        self.run, self.partition, self.rng = run, p, rngs.stream(run.seed, p.seed, p.name)

    @property
    def own(self) -> np.ndarray:
        return self.run.history[self.partition.name][0]

    def past(self, name: str | None = None) -> np.ndarray:
        """Committed rows, the latest first, at the full depth."""
        return self.run.history[name or self.partition.name]

    def has(self, key: str) -> bool:
        return key in self.partition.params_from_upstream or key in self.partition.params

    def p(self, key: str, default=None) -> np.ndarray:
        """A parameter: another partition's row of this step, or a fixed vector."""
        if key in self.partition.params_from_upstream:
            u = self.partition.params_from_upstream[key]
            row = self.run.now[u["upstream"]]
            return row[list(u["indices"])] if u.get("indices") is not None else row
        if key in self.partition.params:
            return np.atleast_1d(np.asarray(self.partition.params[key], float))
        if default is None:
            raise ValueError(f"{self.partition.name}: parameter {key!r} is missing")
        return np.atleast_1d(np.asarray(default, float))

    def partitions(self, key: str) -> list[str]:
        return self.partition.params_as_partitions.get(key, [])

    @property
    def dt(self) -> float:
        return self.run.dt

    @property
    def time(self) -> float:
        """The last committed time."""
        return self.run.times[0]

    @property
    def times(self) -> np.ndarray:
        return self.run.times

    @property
    def step(self) -> int:
        """From 1 on."""
        return self.run.step


class Run:
    """One member's simulation; iterate for (step, time, rows by name)."""

    def __init__(self, settings: Settings, seed: int = 0, overrides: dict[str, np.ndarray] | None = None):
        from .iterations import build

        self.settings, self.seed, self.step, self.dt = settings, seed, 0, 0.0
        self.by_name = {p.name: p for p in settings.partitions}
        self.order = graph.of(settings.partitions).order()
        depth = max([1, *(p.state_history_depth for p in settings.partitions)])
        self.history, self.now = {}, {}
        for p in settings.partitions:
            row = np.array((overrides or {}).get(p.name, p.init_state_values), float)
            if row.ndim == 2:  # a whole history
                rows = np.zeros((p.state_history_depth, row.shape[1]))
                rows[: len(row)] = row[: p.state_history_depth]
            else:
                rows = np.zeros((p.state_history_depth, len(row)))
                rows[0] = row
            self.history[p.name] = rows
            self.now[p.name] = rows[0]
        self.times = np.zeros(depth)
        self.times[0] = settings.init_time
        self.clock = rngs.stream(seed, settings.clock.seed, "clock")
        self.context = {p.name: Context(self, p) for p in settings.partitions}
        self.iterate = {p.name: build(p) for p in settings.partitions}

    def _increment(self) -> float:
        c = self.settings.clock
        if c.kind == "constant":
            return c.stepsize
        if c.kind == "exponential_distribution":
            return float(self.clock.exponential(c.mean))
        if self.step + 1 >= len(c.times):
            raise ValueError("the recorded times end here")
        return float(c.times[self.step + 1] - c.times[self.step])

    def advance(self) -> None:
        self.dt = self._increment()
        self.step += 1
        self.now = {}
        for name in self.order:
            row = np.array(self.iterate[name](self.context[name]), float, ndmin=1)
            if len(row) != self.history[name].shape[1]:
                raise ValueError(f"{name} returned {len(row)} values, not {self.history[name].shape[1]}")
            self.now[name] = row
        for name, row in self.now.items():
            h = self.history[name]
            h[1:] = h[:-1].copy()
            h[0] = row
        self.times[1:] = self.times[:-1].copy()
        self.times[0] += self.dt if self.settings.clock.kind != "recorded" else 0.0
        if self.settings.clock.kind == "recorded":
            self.times[0] = self.settings.clock.times[self.step]

    def done(self) -> bool:
        s = self.settings
        return (s.steps is not None and self.step >= s.steps) or (s.until is not None and self.times[0] >= s.until)

    def __iter__(self):
        yield 0, self.times[0], {n: h[0].copy() for n, h in self.history.items()}
        while not self.done():
            self.advance()
            yield self.step, self.times[0], {n: r.copy() for n, r in self.now.items()}


def simulate(settings: Settings, seed: int = 0) -> dict[str, np.ndarray]:
    """All rows of one member in memory, by partition, with the times under "time"."""
    out: dict[str, list] = {p.name: [] for p in settings.partitions}
    times = []
    for _, t, rows in Run(settings, seed):
        times.append(t)
        for n, r in rows.items():
            out[n].append(r)
    return {n: np.array(r) for n, r in out.items()} | {"time": np.array(times)}


SCHEMA = f"{ID} long, partition_name string, {STEP} long, {TIME} double, state array<double>"


def ensemble(spark: SparkSession, settings: Settings, seeds: Iterable[int] | int, rows: int = 5000) -> DataFrame:
    """The long relation of every member; a task holds one batch of rows, not a member's run."""
    if isinstance(seeds, int):
        members = spark.range(seeds).select(F.col("id").alias("seed"))
    else:
        members = spark.createDataFrame([(int(s),) for s in seeds], "seed long")
    members = members.repartition(max(1, min(10_000, members.count())))

    def run(batches):
        out: list[tuple] = []
        for b in batches:
            for seed in b["seed"]:
                for step, t, by in Run(settings, int(seed)):
                    for n, r in by.items():
                        if settings.record is None or settings.record(n, step):
                            out.append((int(seed), n, step, t, r))
                    if len(out) >= rows:
                        yield pd.DataFrame(out, columns=[ID, "partition_name", STEP, TIME, "state"])
                        out = []
        if out:
            yield pd.DataFrame(out, columns=[ID, "partition_name", STEP, TIME, "state"])

    return members.mapInPandas(run, SCHEMA)


def member_function(settings: Settings):
    """A table function of (seed, steps): the long rows of one member, for SQL's lateral joins
    after ``spark.udtf.register(name, ...)``. Fewer steps than the settings have cut the run."""
    from pyspark.sql.functions import udtf

    class Member:
        def eval(self, seed: int, steps: int):
            for step, t, by in Run(settings, int(seed)):
                if step > steps:
                    return
                for n, r in by.items():
                    if settings.record is None or settings.record(n, step):
                        yield int(seed), n, step, float(t), [float(v) for v in r]

    return udtf(Member, returnType=SCHEMA)
