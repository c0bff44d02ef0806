"""The iteration types of simulated partitions, by name.

A type is a factory: given the partition's specification it returns a function of the step's
context to the next row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from ..functions.expr import Numpy, parse
from ..operators import numeric
from .simulate import Clock, Context, Partition, Run, Settings

REGISTRY: dict[str, Callable] = {}


def register(name: str):
    """Add a type: a factory (spec, partition) -> (context -> row)."""

    def add(f):
        REGISTRY[name] = f
        return f

    return add


def build(p: Partition) -> Callable[[Context], np.ndarray]:
    if callable(p.iteration):
        return p.iteration
    kind = p.iteration.get("type")
    if kind not in REGISTRY:
        raise ValueError(f"{p.name}: no iteration type {kind!r}")
    return REGISTRY[kind](p.iteration, p)


def _simple(name: str):
    def add(f):
        REGISTRY[name] = lambda spec, p: f
        return f

    return add


def _nested(spec: dict, p: Partition) -> Callable:
    return build(Partition(p.name, spec, p.params, p.params_as_partitions, p.params_from_upstream, p.init_state_values, p.state_history_depth, p.seed))


# --- processes ---------------------------------------------------------------------------


def _event(c: Context, rates: np.ndarray) -> np.ndarray:
    return (rates > (rates + 1 / c.dt) * c.rng.random(len(rates))).astype(float)


def _jump(c: Context) -> np.ndarray:
    return c.rng.gamma(c.p("gamma_alphas")) / c.p("gamma_betas")


@_simple("wiener_process")
def _(c):
    return c.own + np.sqrt(c.p("variances") * c.dt) * c.rng.standard_normal(len(c.own))


@_simple("geometric_brownian_motion")
def _(c):
    return c.own * (1 + np.sqrt(c.p("variances") * c.dt) * c.rng.standard_normal(len(c.own)))


@_simple("drift_diffusion")
def _(c):
    return c.own + c.p("drift_coefficients") * c.dt + c.p("diffusion_coefficients") * math.sqrt(c.dt) * c.rng.standard_normal(len(c.own))


@_simple("drift_jump_diffusion")
def _(c):
    noise = c.p("diffusion_coefficients") * math.sqrt(c.dt) * c.rng.standard_normal(len(c.own))
    return c.own + c.p("drift_coefficients") * c.dt + noise + _event(c, c.p("jump_rates")) * _jump(c)


@_simple("ornstein_uhlenbeck")
def _(c):
    return c.own + c.p("thetas") * (c.p("mus") - c.own) * c.dt + c.p("sigmas") * math.sqrt(c.dt) * c.rng.standard_normal(len(c.own))


@_simple("ornstein_uhlenbeck_exact_gaussian")
def _(c):
    th, mu, sg = c.p("thetas"), c.p("mus"), c.p("sigmas")
    safe = np.where(th == 0, 1.0, th)
    var = np.where(th == 0, sg**2 * c.dt, sg**2 * -np.expm1(-2 * safe * c.dt) / (2 * safe))
    return mu + (c.own - mu) * np.exp(-th * c.dt) + np.sqrt(var) * c.rng.standard_normal(len(c.own))


@_simple("compound_poisson_process")
def _(c):
    return c.own + _event(c, c.p("rates")) * _jump(c)


@_simple("poisson_process")
def _(c):
    return c.own + _event(c, c.p("rates"))


REGISTRY["cox_process"] = REGISTRY["poisson_process"]


@_simple("hawkes_process")
def _(c):
    return c.own + _event(c, c.p("intensity"))


@register("hawkes_process_intensity")
def _(spec, p):
    kernel = numeric.kernel(spec.get("kernel", {"type": "exponential"}))

    def run(c):
        past = c.past(c.partitions("hawkes_partition_index")[0])
        total = c.p("background_rates").copy()
        for i in range(1, len(past)):
            total = total + kernel(c, c.times[0], c.times[i], past[0], past[i]) * (past[i - 1] - past[i])
        return total

    return run


@_simple("bernoulli_process")
def _(c):
    return (c.rng.random(len(c.own)) < c.p("state_value_observation_probs")).astype(float)


@_simple("binomial_observation_process")
def _(c):
    seen = c.p("observed_values")[c.p("state_value_observation_indices").astype(int)]
    return c.rng.binomial(seen.astype(int), c.p("state_value_observation_probs")).astype(float)


@_simple("categorical_state_transition")
def _(c):
    at, first = int(c.own[0]), 0
    for k in range(at):
        first += len(c.p(f"transitions_from_{k}"))
    to = c.p(f"transitions_from_{at}")
    weights = np.concatenate([[1 / c.dt], c.p("transition_rates")[first : first + len(to)]])
    k = int(np.searchsorted(np.cumsum(weights), c.rng.random() * weights.sum(), "right"))
    return [at if k == 0 else to[k - 1]]


@_simple("gradient_descent")
def _(c):
    sign = 1.0 if c.p("ascent", 0.0)[0] else -1.0
    return c.own + sign * c.p("learning_rate") * c.p("gradient")


# --- plain values ------------------------------------------------------------------------


@_simple("constant_values")
def _(c):
    return c.own


@_simple("param_values")
def _(c):
    return c.p("param_values")


@_simple("cumulative_time")
def _(c):
    return [c.time + c.dt]


@_simple("copy_values")
def _(c):
    return [c.past(n)[0][int(i)] for n, i in zip(c.partitions("partitions"), c.p("partition_state_values"), strict=True)]


@register("from_storage")
def _(spec, p):
    data = np.array(spec["data"], float).reshape(len(spec["data"]), -1)
    skip = int(spec.get("init_steps_taken", 0))

    def run(c):
        if c.step + skip >= len(data):
            raise ValueError(f"{p.name}: the recorded rows end here")
        return data[c.step + skip]

    return run


@register("from_history")
def _(spec, p):
    data, skip = np.array(spec.get("data", []), float), int(spec.get("init_steps_taken", 0))

    def run(c):
        at = c.step + skip
        return data[len(data) - 1 - at] if at < len(data) else c.p("latest_data_values")

    return run


@register("cumulative")
def _(spec, p):
    inner = _nested(spec["iteration"], p)
    return lambda c: c.own + np.asarray(inner(c), float)


@register("discounted_cumulative")
def _(spec, p):
    inner = _nested(spec["iteration"], p)
    return lambda c: np.asarray(inner(c), float) + c.p("discount_factor") * c.own


@register("expression")
def _(spec, p):
    fields, at = [], 0
    for f in spec.get("fields") or [{"name": p.name, "width": len(p.init_state_values)}]:
        fields.append((f["name"], at, int(f.get("width", 1))))
        at += fields[-1][2]
    bindings = [(b["name"], parse(str(b["expr"]))) for b in spec.get("bindings", [])]
    outputs = [parse(str(o)) for o in spec["outputs"]]
    aliases = spec.get("upstreams", {})

    def run(c):
        names = {n: c.own[i : i + w] for n, i, w in fields}
        names |= {k: c.p(k) for k in {*p.params, *p.params_from_upstream}}
        names |= {a: c.past(n)[0] for a, n in aliases.items()}
        names |= {"dt": np.array([c.dt]), "t": np.array([c.time]), "step": np.array([float(c.step)]), "pi": np.array([math.pi])}

        def history(name, n):
            if name in aliases:
                return c.past(aliases[name])[n]
            i, w = next((i, w) for f, i, w in fields if f == name)
            return c.past()[n][i : i + w]

        e = Numpy(names, c.rng, history)
        for name, tree in bindings:
            e.names[name] = e(tree)
        rows = []
        for (_, _, w), tree in zip(fields, outputs, strict=True):
            v = e(tree)
            rows.append(np.full(w, v[0]) if len(v) == 1 else v)
        return np.concatenate(rows)

    return run


@register("values_function")
def _(spec, p):
    f = spec.get("function")
    if callable(f):
        return f
    if f in (None, "params_transform"):
        keys = spec.get("params", list({**p.params, **p.params_from_upstream}))
        return lambda c: sum(c.p(k) for k in keys)
    raise ValueError(f"{p.name}: values_function needs a function")


@register("values_changing_events")
def _(spec, p):
    branches = {float(b["event"]): _nested(b["iteration"], p) for b in spec["iteration_by_event"]}

    def run(c):
        if c.has("event"):
            event = float(c.p("event")[0])
        else:
            event = float(c.past(c.partitions("event_partition_index")[0])[0][int(c.p("event_state_value_index")[0])])
        if event in branches:
            return branches[event](c)
        return c.p("default_values") if c.has("default_values") else c.own

    return run


# --- windows of simulated rows -----------------------------------------------------------


def _window(c: Context, spec: dict, kernel) -> tuple[np.ndarray, np.ndarray]:
    """Rows (latest first) and weights."""
    name = c.partitions("data_values_partition")[0]
    now, past = c.p("latest_data_values"), c.past(name)
    if c.has("data_values_indices"):
        past = past[:, c.p("data_values_indices").astype(int)]
    t = c.time + c.dt
    w = [kernel(c, t, t, now, now)] + [kernel(c, t, c.times[i], now, past[i]) for i in range(len(past))]
    return np.vstack([now, past]), np.array(w)


@register("values_function_vector_mean")
def _(spec, p):
    kernel, f = numeric.kernel(spec.get("kernel")), spec.get("function", "data_values")

    def run(c):
        rows, w = _window(c, spec, kernel)
        if c.step < len(rows) - 1:
            return c.own
        if (w < 0).any():
            raise ValueError("negative weight")
        g = c.p("past_discounting_factor", 1.0)[0] ** np.arange(len(rows))
        if "other" in f:
            other = c.past(c.partitions("other_values_partition")[0])
            x = np.vstack([c.p("latest_other_values"), other])[: len(rows)]
        else:
            x = rows
        if f == "unit_value":
            x = np.ones((len(rows), 1))
        elif f == "data_values_variance":
            x = (rows - c.p("mean")) ** 2
        elif f.startswith("past_discounted"):
            x = x * g[:, None]
        total = (w[:, None] * x).sum(0)
        if c.p("without_normalisation", 0.0)[0]:
            return total
        return total / (w.sum() - c.p("subtract_from_normalisation", 0.0)[0])

    return run


@register("values_function_vector_covariance")
def _(spec, p):
    kernel = numeric.kernel(spec.get("kernel"))

    def run(c):
        rows, w = _window(c, spec, kernel)
        if c.step < len(rows) - 1:
            return c.own
        d = rows - c.p("mean")
        return np.triu((w[:, None] * d).T @ d / (w.sum() - 1)).ravel()

    return run


@register("values_grouped_aggregation")
def _(spec, p):
    kind, kernel = spec.get("aggregation", "sum"), numeric.kernel(spec.get("kernel") or "constant")
    reduce = {
        "count": lambda w, x: w.sum(), "sum": lambda w, x: (w * x).sum(), "mean": lambda w, x: (w * x).sum() / w.sum(),
        "min": lambda w, x: (w * x).min(), "max": lambda w, x: (w * x).max(),
    }[kind]

    def run(c):
        latest = c.p("latest_states")
        idx = c.p("state_value_indices", np.arange(len(latest))).astype(int)
        history = c.past(c.partitions("state_partition")[0])[: max(0, c.step)]
        rows = np.vstack([latest, history])[:, idx]
        t = c.time + c.dt
        w = np.array([kernel(c, t, t, latest, latest)] + [kernel(c, t, c.times[i], latest, history[i]) for i in range(len(history))], float)
        weights = np.broadcast_to(w[:, None], rows.shape)
        tuples, k = [], 0
        while c.has(f"accepted_value_group_tupindex_{k}"):
            tuples.append(c.p(f"accepted_value_group_tupindex_{k}"))
            k += 1
        digits = int(c.p("float_precision", 0.0)[0])
        keys = []
        for j in range(k):
            g = c.past(c.partitions(f"grouping_partition_tupindex_{j}")[0])[: max(0, c.step)]
            cols = c.p(f"grouping_value_indices_tupindex_{j}", np.arange(rows.shape[1])).astype(int)
            keys.append(np.round(np.vstack([c.p(f"latest_groupings_tupindex_{j}"), g])[:, cols], digits))
        out = c.p("default_values", np.zeros(len(tuples[0])))
        out = np.broadcast_to(out, len(tuples[0])).copy()
        for i, group in enumerate(zip(*[np.round(t, digits) for t in tuples])):
            hit = np.ones(rows.shape, bool)
            for values, want in zip(keys, group):
                hit &= values == want
            if hit.any():
                out[i] = reduce(weights[hit], rows[hit])
        return out

    return run


@register("scalar_regression_stats")
def _(spec, p):
    seen: list[tuple[float, float]] = []

    def run(c):
        seen.append((float(c.p("x")[0]), float(c.p("y")[0])))
        if c.p("scalar_regression_mode", 0.0)[0]:
            del seen[: -int(c.p("scalar_regression_window_length")[0])]
        return numeric.ols(np.array(seen), bool(c.p("scalar_regression_intercept", 0.0)[0]), c.p("scalar_regression_min_denominator", 1e-12)[0])

    return run


@register("values_collection")
def _(spec, p):
    def run(c):
        width, empty = int(c.p("values_state_width")[0]), c.p("empty_value")[0]
        slots = c.own.reshape(-1, width).copy()
        if c.p("pop", 1.0)[0]:
            full = [i for i in range(1, len(slots)) if slots[i, 0] != empty]
            if full:
                slots[0] = slots[full[0]]
                slots[full[0]] = empty
        push = numeric.pushed(c, "next_values_push", "other_partition", "value_indices")
        if push[0] != empty:
            free = [i for i in range(1, len(slots)) if slots[i, 0] == empty]
            if not free:
                raise ValueError(f"{p.name}: the collection is full")
            slots[free[0]] = push
        return slots.ravel()

    return run


@register("values_sorting_collection")
def _(spec, p):
    def run(c):
        width, empty = int(c.p("values_state_width")[0]) + 1, c.p("empty_value")[0]
        slots = [s for s in c.own.reshape(-1, width) if s[0] != empty]
        most = len(c.own) // width
        value = numeric.pushed(c, "next_values_push", "other_partition", "value_indices")
        key = numeric.pushed(c, "next_values_sort_by", "other_partition_sort_by", "value_index_sort_by")
        if value[0] != empty:
            slots.append(np.concatenate([key[:1], value]))
        slots = sorted(slots, key=lambda s: -s[0])[:most]
        return np.concatenate([*slots, np.full((most - len(slots)) * width, empty)])

    return run


def _elite(c: Context):
    width, empty = int(c.p("values_state_width")[0]), c.p("empty_value", -1.0)[0]
    slots = c.p("sorted_collection").reshape(-1, width + 1)
    live = slots[:, 0] != empty
    w = c.p("weights")[: len(slots)][live]
    return slots[live][:, 1:], w


@_simple("values_sorted_collection_mean")
def _(c):
    x, w = _elite(c)
    lr = c.p("learning_rate")[0]
    return c.own if not len(x) else (1 - lr) * c.own + lr * (w[:, None] * x).sum(0) / w.sum()


@_simple("values_sorted_collection_covariance")
def _(c):
    x, w = _elite(c)
    lr = c.p("learning_rate")[0]
    if not len(x):
        return c.own
    w = w / w.sum()
    d = x - (w[:, None] * x).sum(0)
    return (1 - lr) * c.own + lr * ((w[:, None] * d).T @ d).ravel()


@_simple("values_weighted_resampling")
def _(c):
    g, logs, rows = math.log(c.p("past_discounting_factor")[0]), [], []
    pick = c.p("log_weight_indices", np.zeros(len(c.partitions("log_weight_partitions")))).astype(int)
    for k, (lw, dv) in enumerate(zip(c.partitions("log_weight_partitions"), c.partitions("data_values_partitions"), strict=True)):
        for i, (a, b) in enumerate(zip(c.past(lw), c.past(dv))):
            logs.append(a[pick[k]] + i * g)
            rows.append(b)
    logs = np.array(logs)
    w = np.cumsum(np.exp(logs - logs.max()))
    return rows[int(np.searchsorted(w, c.rng.random() * w[-1]))]


# --- inference ---------------------------------------------------------------------------


@register("data_generation")
def _(spec, p):
    like = numeric.likelihood(spec["likelihood"])

    def run(c):
        if c.step % int(c.p("steps_per_resample", 1.0)[0]):
            return c.own
        rho = c.p("correlation_with_previous", 0.0)[0]
        return rho * c.own + (1 - rho) * like(c).sample(c.rng)

    return run


@register("data_comparison")
def _(spec, p):
    like = numeric.likelihood(spec["likelihood"])

    def run(c):
        if c.step < c.p("burn_in_steps", 0.0)[0]:
            return c.own
        value = like(c).loglike(c.p("latest_data_values"))
        return [value + (c.own[0] if c.p("cumulative", 0.0)[0] else 0.0)]

    return run


@register("data_comparison_gradient")
def _(spec, p):
    like = numeric.likelihood(spec["likelihood"])
    return lambda c: like(c).gradient(c.p("latest_data_values"))


def _loglikes(c: Context) -> np.ndarray:
    names = c.partitions("loglike_partitions")
    idx = c.p("loglike_indices", np.zeros(len(names))).astype(int)
    return np.array([[row[k] for row in c.past(n)] for n, k in zip(names, idx)])


@_simple("posterior_log_normalisation")
def _(c):
    l = _loglikes(c)
    steps = np.arange(l.shape[1]) * math.log(c.p("past_discounting_factor")[0])
    return [numeric.log_sum_exp((l + steps).ravel())]


def _blended(c: Context, f):
    """Past and new parts by their share of the total weight."""
    past, l = c.p("posterior_log_normalisation")[0], _loglikes(c)[:, 0]
    total = numeric.log_sum_exp(np.array([numeric.log_sum_exp(l), past]))
    if not np.isfinite(total):
        return c.own
    out = np.exp(past - total) * c.own
    for n, x in zip(c.partitions("param_partitions"), l, strict=True):
        if np.isfinite(x):
            out = out + np.exp(x - total) * f(c.past(n)[0])
    return out


@register("posterior_mean")
def _(spec, p):
    if spec.get("transform", "mean") == "variance":
        return lambda c: _blended(c, lambda x: (c.p("mean") - x) ** 2)
    return lambda c: _blended(c, lambda x: x)


@_simple("posterior_covariance")
def _(c):
    return _blended(c, lambda x: np.outer(x - c.p("mean"), x - c.p("mean")).ravel())


@register("smc_proposal")
def _(spec, p):
    from ..operators.inference import propose

    priors = numeric.priors(spec["priors"])

    def run(c):
        n = int(c.p("num_particles")[0])
        post = c.past(c.partitions("posterior_partition")[0])[0]
        return propose(priors, n, c.rng, None if c.step == 1 else post).ravel()

    return run


@_simple("smc_posterior")
def _(c):
    from ..operators.inference import particle_posterior

    d = int(c.p("num_params")[0])
    mean, cov, logz = particle_posterior(c.p("particle_params").reshape(-1, d), c.p("particle_loglikes"))
    return np.concatenate([mean, cov.ravel(), [logz]])


@_simple("ensemble_kalman_filter")
def _(c):
    from ..operators.inference import enkf_analysis

    n, d = int(c.p("ensemble_size")[0]), int(c.p("state_dimension")[0])
    obs = c.p("observation_indices", np.arange(d)).astype(int)
    return enkf_analysis(c.p("forecast_ensemble").reshape(n, d), c.p("latest_data_values"), c.p("observation_noise_variance"), obs, c.p("inflation", 1.0)[0], c.rng).ravel()


@register("onnx_inference")
def _(spec, p):
    import onnxruntime

    session = onnxruntime.InferenceSession(spec["model_path"])
    inputs = session.get_inputs()

    def run(c):
        feed = {i.name: c.p(i.name).astype("f4").reshape([d if isinstance(d, int) else 1 for d in i.shape]) for i in inputs}
        return np.concatenate([np.ravel(o) for o in session.run(None, feed)]).astype(float)

    return run


@register("embedded")
def _(spec, p):
    """A whole inner run each step. Parameters named ``inner/param`` are forwarded; an inner
    partition may start from outer values or from an outer partition's history."""
    settings: Settings = spec["settings"]

    def run(c):
        if c.step <= c.p("burn_in_steps", 0.0)[0]:
            return c.own
        parts, start, times = [], {}, settings.clock
        for q in settings.partitions:
            params, iteration = dict(q.params), q.iteration
            for key in {*p.params, *p.params_from_upstream}:
                inner, _, name = key.partition("/")
                if inner == q.name and name == "init_state_values":
                    start[q.name] = c.p(key)
                elif inner == q.name:
                    params[name] = c.p(key)
            for key, names in p.params_as_partitions.items():
                inner, _, name = key.partition("/")
                if inner == q.name and name == "initial_state_from_partition_history":
                    start[q.name] = c.past(names[0])
                elif inner == q.name and name == "update_from_partition_history":
                    iteration = {"type": "from_history", "data": c.past(names[0]).tolist(), "init_steps_taken": 0}
                    start[q.name] = c.past(names[0])[-1]
                    params["latest_data_values"] = c.past(names[0])[0]
            parts.append(Partition(q.name, iteration, params, q.params_as_partitions, q.params_from_upstream, q.init_state_values, q.state_history_depth, q.seed))
        inner = Settings(parts, settings.steps, settings.until, float(c.p("init_time_value", settings.init_time)[0]), times)
        last = None
        for _, _, last in Run(inner, c.run.seed * 1_000_003 + c.step, start):
            pass
        return np.concatenate([last[q.name] for q in settings.partitions])

    return run


__all__ = ["REGISTRY", "Clock", "build", "register"]
