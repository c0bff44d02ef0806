"""YAML programs: partitions, expressions, embedded runs, data, macros, and how to run them.

    main:       {partitions: [...], expressions: [...], simulation: {...}}
    embedded:   [{name, partitions, simulation}]
    run:        {mode: batch | ensemble, seeds: [...], concurrency: n}
    data:       {source: {type, ...}} or {partitions, steps, ...}
    macros:     [{type, ...}]

Unknown keys are errors. Names like ``y`` or ``on`` stay strings. Macros over data chain: each
adds its columns as a partition of the storage; live ones make a storage of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, regression, rolling
from ..operators import kernels as k
from ..operators.grouping import grouped_aggregation
from ..operators.likelihood import Gamma, NegativeBinomial, Normal, Poisson, rolling_loglike
from ..operators.numeric import priors
from ..series import ID, STEP, TIME
from ..sources import readers, writers
from . import graph
from .simulate import Clock, Partition, Settings, ensemble, simulate


class _Loader(yaml.SafeLoader):
    """Only true and false are booleans."""


_Loader.yaml_implicit_resolvers = {c: [(t, r) for t, r in rs if t != "tag:yaml.org,2002:bool"] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}
import re as _re  # noqa: E402

for _c, _word in (("t", "true"), ("f", "false")):

    _Loader.add_implicit_resolver("tag:yaml.org,2002:bool", _re.compile(f"^{_word}$"), [_c])


class ProgramError(ValueError):
    pass


def _known(block: dict, where: str, *keys: str) -> dict:
    if not isinstance(block, dict):
        raise ProgramError(f"{where} must be a mapping")
    if extra := sorted(set(block) - set(keys)):
        raise ProgramError(f"{where}: unknown keys {', '.join(map(str, extra))}")
    return block


_PARTITION = ("name", "iteration", "params", "params_as_partitions", "params_from_upstream", "init_state_values", "state_history_depth", "seed")
_EXPRESSION = ("partition", "fields", "upstreams", "bindings", "outputs")


def _partition(block: dict, embedded: dict[str, Settings]) -> Partition:
    _known(block, f"partition {block.get('name')}", *_PARTITION)
    it = block["iteration"]
    it = {"type": it} if isinstance(it, str) else dict(it)
    if it.get("type") == "embedded":
        it["settings"] = embedded[it.pop("run")]
    return Partition(
        block["name"], it, {a: v if isinstance(v, list) else [v] for a, v in block.get("params", {}).items()}, block.get("params_as_partitions", {}),
        block.get("params_from_upstream", {}), block.get("init_state_values", [0.0]), int(block.get("state_history_depth", 1)), int(block.get("seed", 0)),
    )


def _partitions(block: dict, embedded: dict[str, Settings]) -> list[Partition]:
    out = [_partition(p, embedded) for p in block.get("partitions", [])]
    for e in block.get("expressions", []):
        _known(e, "expression", *_EXPRESSION)
        spec = {"type": "expression", **{a: e[a] for a in _EXPRESSION[1:] if a in e}}
        p = _partition({**e["partition"], "iteration": spec}, embedded)
        for n in spec.get("upstreams", {}).values():
            p.params_as_partitions.setdefault("__upstreams", []).append(n)
        out.append(p)
    return out


def _clock(block: dict | None) -> Clock:
    b = dict(block or {"type": "constant"})
    kind = b.pop("type")
    if kind == "constant":
        return Clock("constant", stepsize=float(_known(b, "timestep", "stepsize").get("stepsize", 1.0)))
    if kind == "exponential_distribution":
        _known(b, "timestep", "mean", "seed")
        return Clock(kind, mean=float(b["mean"]), seed=int(b.get("seed", 0)))
    if kind in ("from_storage", "from_history"):
        return Clock("recorded", times=_known(b, "timestep", "data")["data"])
    raise ProgramError(f"no timestep function {kind!r}")


_SIMULATION = ("output_condition", "output_function", "termination_condition", "timestep_function", "init_time_value", "execution_strategy")


def _settings(parts: list[Partition], block: dict) -> Settings:
    _known(block, "simulation", *_SIMULATION)
    end = dict(block.get("termination_condition", {"type": "number_of_steps", "max_steps": 1}))
    kind = end.pop("type")
    if kind == "number_of_steps":
        steps, until = int(_known(end, kind, "max_steps")["max_steps"]), None
    elif kind == "time_elapsed":
        steps, until = None, float(_known(end, kind, "max_time_elapsed")["max_time_elapsed"])
    else:
        raise ProgramError(f"no termination condition {kind!r}")
    return Settings(parts, steps, until, float(block.get("init_time_value", 0.0)), _clock(block.get("timestep_function")))


def _kernel(spec: Any, params: dict) -> k.Kernel:
    spec = {"type": spec} if isinstance(spec, str) else dict(spec or {"type": "instantaneous"})
    kind = spec["type"]
    one = lambda n: float((spec.get(n) or params[n])[0] if isinstance(spec.get(n) or params[n], list) else spec.get(n) or params[n])
    if kind in ("constant", "instantaneous"):
        return k.KERNELS[kind]()
    if kind == "exponential":
        return k.Exponential(one("exponential_weighting_timescale"))
    if kind == "periodic":
        return k.Periodic(one("periodic_weighting_timescale"))
    if kind == "binned":
        return k.Binned(spec.get("bin_values") or params["bin_values"], one("bin_stepsize"))
    if kind == "gaussian_state":
        return k.GaussianState(spec.get("covariance_matrix") or params["covariance_matrix"])
    if kind == "t_distribution_state":
        return k.TDistributionState(spec.get("scale_matrix") or params["scale_matrix"], one("degrees_of_freedom"))
    if kind == "product":
        a, b = spec["kernels"]
        return k.Product(_kernel(a, params), _kernel(b, params))
    raise ProgramError(f"no kernel {kind!r}")


class Storage:
    """The long relation with the width of each partition."""

    def __init__(self, rows: DataFrame, widths: dict[str, int]):
        self.rows, self.widths = rows, widths

    def columns(self, refs: Sequence[dict]) -> tuple[DataFrame, list[list[str]]]:
        """A wide frame of the referenced values, and the columns of each reference."""
        names = list(dict.fromkeys(r["partition_name"] for r in refs))
        for n in names:
            if n not in self.widths:
                raise ProgramError(f"no partition {n!r}")
        rows = self.rows.where(F.col("partition_name").isin(*names))
        wide = rows.groupBy(ID, STEP, TIME).pivot("partition_name", names).agg(F.first("state"))
        picks, out = {}, []
        for r in refs:
            n = r["partition_name"]
            cols = [(f"{n}_{i}", F.element_at(F.col(f"`{n}`"), i + 1)) for i in r.get("value_indices") or range(self.widths[n])]
            picks |= dict(cols)
            out.append([c for c, _ in cols])
        return wide.select(ID, STEP, TIME, *[v.alias(c) for c, v in picks.items()]), out

    def add(self, name: str, df: DataFrame, cols: Sequence[str]) -> "Storage":
        new = df.select(ID, F.lit(name).alias("partition_name"), STEP, TIME, F.array(*cols).alias("state"))
        kept = self.rows.where(F.col("partition_name") != name)
        return Storage(kept.unionByName(new), {**self.widths, name: len(cols)})


MACROS: dict[str, Callable[[SparkSession, Storage | None, dict], Storage]] = {}


def macro(name: str, *keys: str):
    def add(f):
        MACROS[name] = lambda spark, storage, block: f(spark, storage, _known({a: v for a, v in block.items() if a != "type"}, name, *keys))
        return f

    return add


_WINDOW = ("name", "data", "kernel", "depth", "params", "default_value")


@macro("vector_mean", *_WINDOW)
def _(spark, s, b):
    df, (cols,) = s.columns([b["data"]])
    out = rolling.rolling_mean(df, cols, int(b["depth"]), _kernel(b.get("kernel"), b.get("params", {})), default=float(b.get("default_value", 0)))
    return s.add(b["name"], out, [f"{c}_mean" for c in cols])


@macro("vector_variance", *_WINDOW)
def _(spark, s, b):
    df, (cols,) = s.columns([b["data"]])
    out = rolling.rolling_variance(df, cols, int(b["depth"]), _kernel(b.get("kernel"), b.get("params", {})), default=float(b.get("default_value", 0)))
    return s.add(b["name"], out, [f"{c}_var" for c in cols])


@macro("vector_covariance", *_WINDOW)
def _(spark, s, b):
    df, (cols,) = s.columns([b["data"]])
    out, n = rolling.rolling_covariance(df, cols, int(b["depth"]), _kernel(b.get("kernel"), b.get("params", {})), default=float(b.get("default_value", 0))), len(cols)
    return s.add(b["name"], out, [f"cov_{i}_{j}" for i in range(n) for j in range(n)])


@macro("grouped_aggregation", "name", "data", "group_by", "precision", "aggregation", "default_value", "kernel", "depth", "params")
def _(spark, s, b):
    df, (values, *keys) = s.columns([b["data"], *b["group_by"]])
    got = grouped_aggregation(df, values, keys, b["aggregation"], precision=int(b.get("precision", 0)), depth=int(b.get("depth", 0)), default=float(b.get("default_value", 0)), kernel=_kernel(b.get("kernel"), b.get("params", {})))
    rows = got.groupBy(ID, STEP).agg(F.transform(F.array_sort(F.collect_list(F.struct("group_idx", "value"))), lambda e: e["value"]).alias("state"))
    width = got.agg(F.max("group_idx")).first()[0] + 1
    rows = rows.join(df.select(ID, STEP, TIME), [ID, STEP]).select("*", *[F.element_at("state", i + 1).alias(f"g{i}") for i in range(width)])
    return s.add(b["name"], rows, [f"g{i}" for i in range(width)])


@macro("scalar_regression_stats", "name", "y", "x", "intercept", "window_length", "min_denominator")
def _(spark, s, b):
    df, ((y,), (x,)) = s.columns([b["y"], b["x"]])
    intercept = bool(b.get("intercept", False))
    out = regression.ols(df, y, x, intercept=intercept, window=b.get("window_length"), least_denominator=float(b.get("min_denominator", 1e-12)))
    cols = ["n", "sx", "sy", "sxx", "sxy", "syy", "alpha", "beta", "sigma2"] if intercept else ["sxx", "sxy", "syy", "n", "beta", "sigma2"]
    return s.add(b["name"], out, cols)


_LIKELIHOODS = {
    "normal": lambda p: Normal(p["mean"], p.get("variance"), p.get("covariance_matrix")), "poisson": lambda p: Poisson(p["mean"]),
    "gamma": lambda p: Gamma(p["mean"], p["variance"]), "negative_binomial": lambda p: NegativeBinomial(p["mean"], p["variance"]),
}


@macro("likelihood_comparison", "name", "data", "likelihood", "params", "window_depth")
def _(spark, s, b):
    df, (cols,) = s.columns([b["data"]])
    out = rolling_loglike(df, _LIKELIHOODS[b["likelihood"]](b["params"]), cols, int(b["window_depth"]))
    return s.add(b["name"], out, ["loglike"])


@macro("likelihood_mean_function_fit", "name", "data", "variance", "window_depth", "learning_rate", "descent_steps")
def _(spark, s, b):
    df, (cols,) = s.columns([b["data"]])
    out = inference.fit_mean(df, cols, b["variance"], int(b["window_depth"]), learning_rate=float(b["learning_rate"]), descent_steps=int(b["descent_steps"]))
    return s.add(b["name"], out, [f"fit_{c}" for c in cols])


@macro("posterior_estimation", "name", "data", "noise_variance", "prior", "window_depth", "past_discount", "seed")
def _(spark, s, b):
    df, ((col,),) = s.columns([b["data"]])
    out = inference.posterior_estimation(df, col, float(b["noise_variance"]), priors([b["prior"]])[0], depth=int(b["window_depth"]), discount=float(b.get("past_discount", 1.0)), seed=int(b.get("seed", 0)))
    return s.add(b["name"], out, ["post_mean", "post_var"])


@macro("ensemble_kalman_filter", "name", "data", "ensemble_size", "persistence", "process_variance", "observation_noise_variance", "inflation", "seed")
def _(spark, s, b):
    df, ((col,),) = s.columns([b["data"]])
    out = inference.ensemble_kalman_filter(df, col, members=int(b["ensemble_size"]), persistence=float(b["persistence"]), process_variance=float(b["process_variance"]), noise=float(b["observation_noise_variance"]), inflation=float(b.get("inflation", 1.0)), seed=int(b.get("seed", 0)))
    return s.add(b["name"], out, ["filtered", "spread"])


def _live(rows: DataFrame, name: str, cols: Sequence[str], step: str) -> Storage:
    long = rows.select(F.lit(0).cast("long").alias(ID), F.lit(name).alias("partition_name"), F.col(step).cast("long").alias(STEP), F.col(step).cast("double").alias(TIME), F.array(*[F.col(c).cast("double") for c in cols]).alias("state"))
    return Storage(long, {name: len(cols)})


@macro("smc_inference", "name", "priors", "data", "likelihood_variance", "num_particles", "num_rounds", "seed")
def _(spark, s, b):
    import numpy as np

    if len(b["priors"]) != 1:
        raise ProgramError("smc_inference fits one normal mean, so it takes one prior")
    ps, x, v = priors(b["priors"]), np.array(b["data"], float), float(b["likelihood_variance"])
    rows = inference.run_smc(spark, ps, lambda p, g: float(-0.5 * ((x - p[0]) ** 2 / v).sum()), particles=int(b["num_particles"]), rounds=int(b["num_rounds"]), seed=int(b.get("seed", 0)))
    return _live(rows, b["name"], rows.columns[1:], "round")


@macro("evolution_strategy_optimisation", "name", "reward", "initial_mean", "initial_covariance", "rounds", "chains", "elite", "learning_rate", "seed")
def _(spark, s, b):
    import numpy as np

    from ..functions.expr import evaluate

    d, text = len(b["initial_mean"]), b["reward"]
    rows = inference.evolution_strategy(spark, lambda a: float(evaluate(text, {"a": a})[0]), b["initial_mean"], np.array(b["initial_covariance"], float).reshape(d, d), rounds=int(b["rounds"]), chains=int(b.get("chains", 1)), elite=int(b.get("elite", 5)), learning_rate=float(b.get("learning_rate", 0.2)), seed=int(b.get("seed", 0)))
    return _live(rows, b["name"], rows.columns[1:], "chain")


@macro("mcts_self_play", "name", "environment", "games", "simulations", "seed")
def _(spark, s, b):
    from ..operators.search import TicTacToe, self_play

    if b.get("environment", "tictactoe") != "tictactoe":
        raise ProgramError(f"no environment {b['environment']!r}")
    rows = self_play(spark, TicTacToe, int(b["games"]), seed=int(b.get("seed", 0)), simulations=int(b.get("simulations", 120)))
    return _live(rows, b["name"], ["n_moves", "score"], "game")


@macro("mcts_planning", "name", "reward", "transition", "noise", "initial", "actions", "horizon", "discount", "least", "most", "roots", "simulations", "seed")
def _(spark, s, b):
    from ..functions.expr import evaluate
    from ..operators.search import SimulationEnvironment, plan

    def step(state, action, g):
        names = {"x": state, "a": [float(action)], "z": [g.normal(0, float(b.get("noise", 0.0)))]}
        new = tuple(float(v) for v in evaluate(b["transition"], names))
        return new, float(evaluate(b["reward"], {"x": new, "a": [float(action)]})[0])

    env = lambda: SimulationEnvironment(step, tuple(map(float, b["initial"])), int(b["actions"]), int(b["horizon"]), float(b.get("discount", 1.0)), float(b["least"]), float(b["most"]))
    rows = plan(spark, env, int(b.get("roots", 8)), seed=int(b.get("seed", 0)), simulations=int(b.get("simulations", 120)), chance=float(b.get("noise", 0.0)) > 0)
    return _live(rows, b["name"], ["visits"], "action")


class Program:
    def __init__(self, text: str):
        tree = _known(yaml.load(text, _Loader) or {}, "program", "main", "embedded", "run", "data", "macros")
        if "main" in tree and "macros" in tree:
            raise ProgramError("main and macros exclude each other")
        self.embedded: dict[str, Settings] = {}
        for e in tree.get("embedded", []):
            _known(e, "embedded", "name", "partitions", "expressions", "simulation")
            self.embedded[e["name"]] = _settings(_partitions(e, self.embedded), e.get("simulation", {}))
        self.run_block = _known(tree.get("run", {}), "run", "mode", "seeds", "concurrency")
        self.main = None
        if "main" in tree:
            m = _known(tree["main"], "main", "partitions", "expressions", "simulation")
            self.simulation = m.get("simulation", {})
            self.main = _settings(_partitions(m, self.embedded), self.simulation)
        self.data, self.macros = tree.get("data"), tree.get("macros", [])
        for b in self.macros:
            if b.get("type") not in MACROS:
                raise ProgramError(f"no macro {b.get('type')!r}")

    def graph(self) -> graph.Graph:
        return graph.of(self.main.partitions)

    def _data(self, spark: SparkSession) -> Storage:
        b = _known(self.data, "data", "source", "partitions", "expressions", "steps", "timestep", "init_time")
        if "source" in b:
            src = dict(b["source"])
            rows = readers.load(spark, src.pop("type"), **src)
            widths = {r.partition_name: r.w for r in rows.groupBy("partition_name").agg(F.max(F.size("state")).alias("w")).collect()}  # one row a partition
            return Storage(rows, widths)
        s = Settings(_partitions(b, self.embedded), int(b["steps"]), None, float(b.get("init_time", 0.0)), _clock(b.get("timestep")))
        return Storage(ensemble(spark, s, [0]), {p.name: len(p.init_state_values) for p in s.partitions})

    def run(self, spark: SparkSession) -> DataFrame:
        """The long relation that the program makes; its sink, if it names one, is written."""
        if self.main is None:
            storage = self._data(spark) if self.data else None
            for b in self.macros:
                storage = MACROS[b["type"]](spark, storage, b)
            return storage.rows
        seeds = self.run_block.get("seeds", [0]) if self.run_block.get("mode", "batch") == "ensemble" else [0]
        rows = ensemble(spark, self.main, seeds)
        cond = dict(self.simulation.get("output_condition") or {"type": "every_step"})
        rows = writers.condition(rows, cond.pop("type"), **cond)
        if out := dict(self.simulation.get("output_function") or {}):
            writers.write(rows, out.pop("type"), **out)
        return rows

    def run_local(self, seed: int = 0) -> dict:
        """One member in the driver's process, for small programs."""
        return simulate(self.main, seed)


def main(args: list[str] | None = None) -> int:
    """tidewheel-program --config FILE [--graph mermaid|dot]"""
    import argparse

    p = argparse.ArgumentParser()
    p.add_argument("--config", required=True)
    p.add_argument("--graph", choices=["mermaid", "dot"])
    a = p.parse_args(args)
    program = Program(open(a.config).read())
    if a.graph:
        print(getattr(program.graph(), a.graph)())
        return 0
    spark = SparkSession.builder.getOrCreate()
    rows = program.run(spark)
    if not (program.main and program.simulation.get("output_function")):
        writers.write_stdout(rows)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
