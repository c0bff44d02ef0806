"""Queries of simulation, inference and search. Random, so they have no SQL; tests pin them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import inference, processes, search
from .operators.likelihood import Prior
from .plans.simulate import Partition, Settings, ensemble
from .series import ID, STEP, TIME, events_by_user

MEMBERS, STEPS = 200, 200


def _final(df: DataFrame) -> DataFrame:
    return df.where(F.col(STEP) == STEPS)


def _grid(spark: SparkSession) -> DataFrame:
    return processes.grid(spark, MEMBERS, STEPS)


def wiener_paths(spark, d):
    return processes.wiener(_grid(spark), [1.0, 2.0], [0.0, 0.0], 1)


def drift_diffusion_paths(spark, d):
    return processes.drift_diffusion(_grid(spark), [0.1], [0.5], [1.0], 2)


def gbm_paths(spark, d):
    return processes.geometric_brownian(_grid(spark), [0.01], [1.0], 3)


def ou_paths(spark, d):
    return processes.ornstein_uhlenbeck(_grid(spark), [0.1], [2.0], [0.3], [0.0], 4)


def ou_exact_paths(spark, d):
    return processes.ornstein_uhlenbeck(_grid(spark), [0.1], [2.0], [0.3], [0.0], 5, exact=True)


def poisson_paths(spark, d):
    return processes.poisson_process(_grid(spark), [0.5], [0.0], 6)


def cox_paths(spark, d):
    return processes.cox_process(_grid(spark).withColumn("rate", 0.5 + 0.5 * F.sin(F.col(TIME))), ["rate"], [0.0], 7)


def compound_poisson_paths(spark, d):
    return processes.compound_poisson(_grid(spark), [0.5], [2.0], [4.0], [0.0], 8)


def drift_jump_paths(spark, d):
    return processes.drift_jump_diffusion(_grid(spark), [0.1], [0.2], [0.3], [2.0], [4.0], [0.0], 9)


def bernoulli_rows(spark, d):
    return processes.bernoulli_process(_grid(spark), [0.3, 0.7], 10)


def binomial_rows(spark, d):
    return processes.binomial_observation(_grid(spark).withColumn("n", F.lit(20.0)), ["n"], [0.25], 11)


def hawkes_ensemble(spark, d):
    parts = [
        Partition("intensity", {"type": "hawkes_process_intensity", "kernel": {"type": "exponential"}}, {"background_rates": [0.2], "exponential_weighting_timescale": [2.0]}, {"hawkes_partition_index": ["events"]}, {}, [0.2]),
        Partition("events", {"type": "hawkes_process"}, {}, {}, {"intensity": {"upstream": "intensity"}}, [0.0], 10),
    ]
    return ensemble(spark, Settings(parts, 60), 20)


def ctmc_ensemble(spark, d):
    p = Partition("state", {"type": "categorical_state_transition"}, {"transitions_from_0": [1], "transitions_from_1": [0, 2], "transitions_from_2": [1], "transition_rates": [0.5, 0.2, 0.3, 0.4]}, init_state_values=[0.0])
    return ensemble(spark, Settings([p], 100), 20)


def expression_ensemble(spark, d):
    logistic = {"type": "expression", "fields": [{"name": "n", "width": 1}], "outputs": ["n * exp(r * (1 - n / k) + shared(normal(0, s)))"]}
    parts = [Partition("fish", logistic, {"r": [0.5], "k": [10.0], "s": [0.1]}, init_state_values=[1.0]), Partition("caught", {"type": "expression", "fields": [{"name": "c", "width": 1}], "outputs": ["c + 0.1 * fish"]}, {}, {}, {"fish": {"upstream": "fish"}}, [0.0])]
    return ensemble(spark, Settings(parts, 100), 50)


def _whole(c):
    return c == F.floor(c)


#: By process: its rows, what holds of each row (x, the value before, the step), and the mean of
#: the last rows, or of all rows, with the distance that chance allows: some six standard errors.
INVARIANTS = {
    "wiener": (wiener_paths, lambda x, y: F.isnotnull(x) & (F.abs(x) < 200), 0.0, 6.0),
    "drift_diffusion": (drift_diffusion_paths, lambda x, y: F.abs(x - y - 0.1) < 4, 21.0, 3.0),
    "gbm": (gbm_paths, lambda x, y: (x > 0) & (F.abs(x / y - 1) < 0.8), 1.0, 1.5),
    "ou": (ou_paths, lambda x, y: F.abs(x - y - 0.1 * (2 - y)) < 2.5, 2.0, 0.5),
    "ou_exact": (ou_exact_paths, lambda x, y: F.abs(x - 2 - (y - 2) * F.exp(F.lit(-0.1))) < 2.5, 2.0, 0.5),
    "poisson": (poisson_paths, lambda x, y: (x - y).isin(0.0, 1.0), 200 / 3, 3.0),
    "cox": (cox_paths, lambda x, y: (x - y).isin(0.0, 1.0), 60.0, 10.0),
    "compound_poisson": (compound_poisson_paths, lambda x, y: x >= y, 200 / 6, 3.0),
    "drift_jump": (drift_jump_paths, lambda x, y: x - y > 0.1 - 0.2 * 8, 20 + 200 * 0.3 / 1.3 / 2, 4.0),
    "bernoulli": (bernoulli_rows, lambda x, y: x.isin(0.0, 1.0), 0.3, 0.3),
    "binomial": (binomial_rows, lambda x, y: _whole(x) & x.between(0, 20), 5.0, 1.0),
}


def process_invariants(spark, d):
    """Per process: rows, rows whose step from the one before is impossible, and whether the
    last rows' mean is where the process has it."""
    from pyspark.sql import Window

    out = None
    for name, (rows, holds, mean, near) in INVARIANTS.items():
        df = rows(spark, d)
        x = next(c for c in df.columns if c not in (ID, STEP, TIME, "n", "rate"))
        df = df.select(ID, STEP, F.col(x).alias("x"), F.lag(x).over(Window.partitionBy(ID).orderBy(STEP)).alias("y"))
        one = df.agg(
            F.count(F.lit(1)).cast("int").alias("n"),
            F.sum(F.when((F.col(STEP) >= 1) & ~F.coalesce(holds(F.col("x"), F.col("y")), F.lit(False)), 1).otherwise(0)).cast("int").alias("broken"),
            (F.abs(F.avg(F.when(F.col(STEP) == STEPS, F.col("x"))) - mean) < near).alias("centred"),
        ).select(F.lit(name).alias("process"), "n", "broken", "centred")
        out = one if out is None else out.unionByName(one)
    return out


_OBSERVED = np.random.default_rng(0).normal(2.0, 1.0, 50)


def smc_posterior(spark, d):
    return inference.run_smc(spark, [Prior("uniform", -5.0, 10.0)], lambda x, g: float(-0.5 * ((_OBSERVED - x[0]) ** 2).sum()), particles=400, rounds=3)


def enkf_filter(spark, d):
    return inference.ensemble_kalman_filter(events_by_user(spark, d), "value", members=10, persistence=0.9, process_variance=100.0, noise=400.0)


def evolution(spark, d):
    return inference.evolution_strategy(spark, lambda a: -((a[0] - 3) ** 2 + (a[1] + 2) ** 2), [0.0, 0.0], 9 * np.eye(2), rounds=600, chains=8, elite=10, learning_rate=0.05)


def mean_fit(spark, d):
    return inference.fit_mean(events_by_user(spark, d), ["value"], [400.0], 7, learning_rate=40.0, descent_steps=5)


def posterior_chain(spark, d):
    return inference.posterior_estimation(events_by_user(spark, d), "value", 400.0, Prior("uniform", 0.0, 200.0), depth=10, discount=0.95)


def mcts_games(spark, d):
    return search.self_play(spark, search.TicTacToe, 8, simulations=60)


def _drift(state, action, g):
    x = state[0] + (action - 1) + g.normal(0, 0.2)
    return (round(x, 1),), -abs(x - 2)


def mcts_plan(spark, d):
    return search.plan(spark, lambda: search.SimulationEnvironment(_drift, (0.0,), 3, 4, 0.95, -20.0, 0.0), 16, simulations=60, chance=True)


def _checked(df: DataFrame, name: str, holds) -> DataFrame:
    broken = F.sum(F.when(F.coalesce(holds, F.lit(False)), 0).otherwise(1))
    return df.agg(F.count(F.lit(1)).cast("int").alias("n"), F.coalesce(broken, F.lit(0)).cast("int").alias("broken")).select(F.lit(name).alias("name"), "n", "broken")


#: The filter's variance once it no longer depends on the start, from P = 400 (0.81 P + 100) / (0.81 P + 500).
_SETTLED = ((-176 + (176**2 + 4 * 0.81 * 40_000) ** 0.5) / (2 * 0.81)) ** 0.5


def inference_invariants(spark, d):
    """Per operator: rows, and rows that contradict what must hold of each, whatever was drawn:
    the exact posterior, the optimum, the settled spread, possible steps, legal games."""
    from pyspark.sql import Window

    c = F.col
    state = lambda df: df.withColumn("x", F.element_at("state", 1))
    before = lambda *by: F.lag("x").over(Window.partitionBy(ID, *by).orderBy(STEP))
    smc = smc_posterior(spark, d).where(c("round") == 2)
    spread = enkf_filter(spark, d).where(c(STEP) >= 3).agg(F.avg("spread").alias("s"))
    hawkes = state(hawkes_ensemble(spark, d))
    hawkes = hawkes.withColumn("y", before("partition_name"))
    event = (c("partition_name") == "events") & (c("x") - c("y")).isin(0.0, 1.0) | (c("partition_name") == "intensity") & (c("x") >= 0.2 - 1e-12)
    jumps = state(ctmc_ensemble(spark, d))
    jumps = jumps.withColumn("y", before())
    fish = expression_ensemble(spark, d).groupBy(ID, STEP).pivot("partition_name", ["fish", "caught"]).agg(F.first(F.element_at("state", 1)))
    fish = fish.withColumn("y", F.lag("caught").over(Window.partitionBy(ID).orderBy(STEP)))
    games, plan = mcts_games(spark, d), mcts_plan(spark, d)
    best = plan.agg(F.max_by("action", "visits").alias("a"), F.sum("visits").alias("v"))
    rows = [
        _checked(smc, "smc_posterior", (F.abs(c("mean_0") - float(_OBSERVED.mean())) < 0.06) & c("cov_0_0").between(0.01, 0.03)),
        _checked(evolution(spark, d), "evolution", (F.abs(c("mean_0") - 3) < 0.01) & (F.abs(c("mean_1") + 2) < 0.01) & c("best").between(-1e-4, 0)),
        _checked(spread, "enkf_filter", F.abs(c("s") / _SETTLED - 1) < 0.1),
        _checked(posterior_chain(spark, d), "posterior_chain", c("post_mean").between(0, 200) & c("post_var").between(0, 200**2) & ((c(STEP) >= 10) | (F.abs(c("post_var") - 200**2 / 12) < 1e-6))),
        _checked(hawkes.where(c(STEP) >= 1), "hawkes_process", event),
        _checked(jumps.where(c(STEP) >= 1), "categorical_state_transition", c("x").isin(0.0, 1.0, 2.0) & (F.abs(c("x") - c("y")) <= 1)),
        _checked(fish.where(c(STEP) >= 1), "expression", (c("fish") > 0) & (F.abs(c("caught") - c("y") - 0.1 * c("fish")) < 1e-9)),
        _checked(games, "mcts_self_play", c("n_moves").between(5, 9) & (F.size(F.array_distinct("moves")) == c("n_moves")) & F.forall("moves", lambda m: m.between(0, 8)) & (c("score").isin(0.0, 1.0) | (c("score") == 0.5) & (c("n_moves") == 9))),
        _checked(best, "mcts_planning", (c("a") == 2) & (c("v") == 16 * 60)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        wiener_paths, drift_diffusion_paths, gbm_paths, ou_paths, ou_exact_paths, poisson_paths, cox_paths, compound_poisson_paths, drift_jump_paths,
        bernoulli_rows, binomial_rows, hawkes_ensemble, ctmc_ensemble, expression_ensemble, smc_posterior, enkf_filter, evolution, mean_fit,
        posterior_chain, mcts_games, mcts_plan,
    )
}


def _block(model: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        from .operators.paths import paths

        return paths(spark, model, 10_000, 2_000)

    return run


QUERIES |= {f"paths_{m}": _block(m) for m in ("gbm", "ou", "compound_poisson", "coupled_ou", "branch")}
