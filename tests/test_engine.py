"""Simulation, programs, sources, sinks, streams and search."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel import simulations
from tidewheel.operators.paths import paths
from tidewheel.operators.search import Search, SimulationEnvironment, TicTacToe, update_belief
from tidewheel.plans.graph import Graph
from tidewheel.plans.iterations import REGISTRY
from tidewheel.plans.program import Program, ProgramError
from tidewheel.plans.simulate import Clock, Partition, Settings, ensemble, member_function, simulate
from tidewheel.series import ID, STEP, DataRef, to_long
from tidewheel.sources import readers, writers
from tidewheel.streaming import stateful

TYPES = """wiener_process gradient_descent ornstein_uhlenbeck ornstein_uhlenbeck_exact_gaussian geometric_brownian_motion drift_diffusion cumulative_time
poisson_process cox_process bernoulli_process binomial_observation_process categorical_state_transition hawkes_process values_sorted_collection_mean
values_sorted_collection_covariance constant_values copy_values param_values values_weighted_resampling posterior_covariance posterior_log_normalisation
ensemble_kalman_filter smc_posterior from_storage from_history compound_poisson_process drift_jump_diffusion values_function_vector_mean
values_function_vector_covariance values_grouped_aggregation cumulative discounted_cumulative data_generation data_comparison posterior_mean smc_proposal
values_function values_changing_events hawkes_process_intensity values_collection values_sorting_collection expression onnx_inference embedded""".split()


def test_every_type_is_there():
    assert not set(TYPES) - set(REGISTRY)


def one(iteration, params=None, init=(0.0,), steps=5, **more):
    return simulate(Settings([Partition("p", iteration, params or {}, init_state_values=init, **more)], steps))["p"]


def test_simple_types():
    assert one({"type": "cumulative_time"}).ravel().tolist() == [0, 1, 2, 3, 4, 5]
    assert one({"type": "cumulative", "iteration": {"type": "param_values"}}, {"param_values": [2.0]}).ravel().tolist() == [0, 2, 4, 6, 8, 10]
    assert one({"type": "discounted_cumulative", "iteration": {"type": "param_values"}}, {"param_values": [1.0], "discount_factor": [0.5]}, steps=3).ravel().tolist() == [0, 1, 1.5, 1.75]
    assert one({"type": "from_storage", "data": [[0], [5], [6]]}, steps=2).ravel().tolist() == [0, 5, 6]
    assert one({"type": "values_changing_events", "iteration_by_event": [{"event": 1, "iteration": {"type": "param_values"}}]}, {"event": [1.0], "param_values": [9.0]}, steps=1).ravel().tolist() == [0, 9]
    with pytest.raises(ValueError):
        one({"type": "from_storage", "data": [[0], [5]]}, steps=2)
    q = one({"type": "values_collection"}, {"values_state_width": [1], "empty_value": [-1], "next_values_push": [4], "pop": [0]}, init=(-1, -1, -1, -1), steps=2)
    assert q[-1].tolist() == [-1, 4, 4, -1]
    s = [Partition("x", {"type": "from_storage", "data": [[0], [3], [9], [5]]}), Partition("top", {"type": "values_sorting_collection"}, {"values_state_width": [1], "empty_value": [-1]}, {}, {"next_values_push": {"upstream": "x"}, "next_values_sort_by": {"upstream": "x"}}, [-1.0] * 4)]
    assert simulate(Settings(s, 3))["top"][-1].tolist() == [9, 9, 5, 5]


def test_a_collection_feeds_another():
    source = Partition("a", {"type": "values_collection"}, {"values_state_width": [1], "empty_value": [-1], "next_values_push": [-1], "pop": [1]}, init_state_values=(-1, 7, 8, -1))
    sink = Partition("b", {"type": "values_collection"}, {"values_state_width": [1], "empty_value": [-1], "pop": [0]}, {"other_partition": ["a"]}, init_state_values=(-1, -1, -1, -1))
    got = simulate(Settings([source, sink], 2))
    assert got["a"][-1].tolist() == [8, -1, -1, -1] and got["b"].tolist() == [[-1] * 4, [-1] * 4, [-1, 7, -1, -1]]


def test_members_as_a_table_function(spark):
    settings = Settings([Partition("w", {"type": "wiener_process"}, {"variances": [1.0]}, init_state_values=[0.0])], 6)
    spark.udtf.register("members", member_function(settings))
    got = spark.sql("SELECT m.* FROM VALUES (0), (1) AS s(seed), LATERAL members(s.seed, 4) m")
    want = ensemble(spark, settings, 2).where(F.col(STEP) <= 4)
    key = lambda df: sorted((r[ID], r[STEP], r["time"], tuple(r["state"])) for r in df.collect())
    assert key(got) == key(want) and got.count() == 10


def test_a_single_row_is_guarded(spark):
    long = to_long(spark.createDataFrame([(1, k, float(k), k * 2.0) for k in range(4)], f"{ID} long, {STEP} long, time double, v double"), {"p": ["v"]})
    assert [tuple(r) for r in DataRef("p").row(long, 1, 3).collect()] == [(1, 3, 3.0, 6.0)]
    for step in (4, -1):
        with pytest.raises(Exception, match="beyond the last"):
            DataRef("p").row(long, 1, step).collect()


def test_window_types():
    data = [[1.0, 4.0], [2.0, 5.0], [3.0, 6.0]]
    src = Partition("d", {"type": "from_storage", "data": data}, init_state_values=data[0], state_history_depth=2)
    up = {"latest_data_values": {"upstream": "d"}}
    mean = Partition("m", {"type": "values_function_vector_mean", "kernel": "constant"}, {}, {"data_values_partition": ["d"]}, up, [0.0, 0.0])
    cov = Partition("c", {"type": "values_function_vector_covariance", "kernel": "constant"}, {}, {"data_values_partition": ["d"]}, {**up, "mean": {"upstream": "m"}}, [0.0] * 4)
    got = simulate(Settings([cov, mean, src], 2))
    assert got["m"].tolist() == [[0, 0], [0, 0], [2, 5]] and got["c"][-1].tolist() == [1, 1, 0, 1]


def test_statistics():
    x = one({"type": "ornstein_uhlenbeck"}, {"thetas": [1.0], "mus": [3.0], "sigmas": [0.1]}, steps=400)
    assert abs(x[100:].mean() - 3) < 0.1
    n = one({"type": "poisson_process"}, {"rates": [1.0]}, steps=2000)[-1, 0]
    assert abs(n / 2000 - 0.5) < 0.05
    g = one({"type": "data_generation", "likelihood": "normal"}, {"mean": [1.8, 5.0], "covariance_matrix": [2.5, 0, 0, 9]}, init=(0, 0), steps=2000)
    assert np.abs(g[1:].mean(0) - [1.8, 5.0]).max() < 0.3


def test_embedded_and_clock():
    inner = Settings([Partition("n", {"type": "expression", "fields": [{"name": "n", "width": 1}], "outputs": ["n + k"]}, {"k": [1.0]}, init_state_values=[0.0])], 3)
    outer = [Partition("k", {"type": "cumulative_time"}, init_state_values=[0.0]), Partition("run", {"type": "embedded", "settings": inner}, {"burn_in_steps": [0]}, {}, {"n/k": {"upstream": "k"}}, [0.0])]
    assert simulate(Settings(outer, 3))["run"].ravel().tolist() == [0, 3, 6, 9]
    times = simulate(Settings([Partition("p", {"type": "cumulative_time"})], None, 3.5))["time"]
    assert times.tolist() == [0, 1, 2, 3, 4]  # the row that crosses is there
    times = simulate(Settings([Partition("p", {"type": "constant_values"})], 500, clock=Clock("exponential_distribution", mean=2.0)))["time"]
    assert abs(np.diff(times).mean() - 2) < 0.4


def test_settings_are_checked():
    with pytest.raises(ValueError, match="cycle"):
        simulate(Settings([Partition("a", {"type": "param_values"}, {}, {}, {"param_values": {"upstream": "b"}}), Partition("b", {"type": "param_values"}, {}, {}, {"param_values": {"upstream": "a"}})], 1))
    with pytest.raises(ValueError, match="beyond"):
        Settings([Partition("a", "x"), Partition("b", "x", {}, {}, {"q": {"upstream": "a", "indices": [1]}})])
    with pytest.raises(ValueError, match="repeat"):
        Settings([Partition("a", "x"), Partition("a", "x")])
    g = Graph(["a", "b"], [("a", "b", "x")], [("b", "a", "y")])
    assert g.order() == ["a", "b"] and g.feedback() == [{"a", "b"}] and "-->" in g.mermaid() and "digraph" in g.dot()


def test_ensemble_repeats(spark):
    s = Settings([Partition("w", {"type": "wiener_process"}, {"variances": [1.0]})], 20)
    a, b = (ensemble(spark, s, 5).orderBy(ID, STEP).collect() for _ in range(2))
    assert a == b and len(a) == 105 and len({tuple(r.state) for r in a if r.step == 20}) == 5


def test_paths(spark):
    p = paths(spark, "ou", 1000, 400, dt=0.1, block=300)
    r = p.agg(F.avg("x0"), F.count("*"), F.countDistinct(ID)).first()
    assert abs(r[0] - 1.0) < 0.05 and r[1] == r[2] == 1000
    assert paths(spark, "gbm", 10, 100, every=25).count() == 40
    jumps = paths(spark, "compound_poisson", 2000, 100, dt=1.0, init=0.0).agg(F.avg("x0")).first()[0]
    assert abs(jumps - 100 * 0.1 / 1.1 * 0.5) < 0.3


@pytest.mark.parametrize("name", ["wiener_paths", "gbm_paths", "poisson_paths", "cox_paths", "compound_poisson_paths", "hawkes_ensemble", "ctmc_ensemble", "expression_ensemble", "mean_fit", "posterior_chain"])
def test_simulation_queries(spark, sf, name):
    assert simulations.QUERIES[name](spark, sf).count() > 0


def test_wiener_variance(spark, sf):
    r = simulations.wiener_paths(spark, sf).where(F.col(STEP) == 200).agg(F.var_samp("x0"), F.var_samp("x1")).first()
    assert 140 < r[0] < 270 and 280 < r[1] < 540


def test_smc_and_evolution(spark, sf):
    last = simulations.smc_posterior(spark, sf).orderBy(F.desc("round")).first()
    assert abs(last.mean_0 - 2.0) < 0.4
    es = simulations.evolution(spark, sf).collect()
    assert all(abs(r.mean_0 - 3) < 0.7 and abs(r.mean_1 + 2) < 0.7 for r in es)


def test_search(spark, sf):
    g = np.random.default_rng(1)
    x = (1, 1, 0, 2, 2, 0, 0, 0, 0)  # the first player wins at 2
    assert Search(TicTacToe(), simulations=200).run(x, g)[0] == 2
    games = simulations.mcts_games(spark, sf).collect()
    assert all(5 <= r.n_moves <= 9 and r.score in (0.0, 0.5, 1.0) for r in games)
    best = simulations.mcts_plan(spark, sf).orderBy(F.desc("visits")).first()
    assert best.action == 2
    w = update_belief(np.array([0.5, 0.5]), np.array([0.0, 3.0]), 1.0)
    assert w[0] > 0.95
    env = SimulationEnvironment(lambda s, a, g: (s, float(a)), (), 2, 3, most=3.0)
    assert Search(env, simulations=100).run(env.start(), g)[0] == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,x,y,z\n0,1,2,3\n2,4,5,6\n1,7,8,9\n")
    got = readers.load(spark, "csv", path=str(tmp_path / "a.csv"), time_column=0, state_columns={"p": [2, 1], "q": [3]}, header=True)
    assert [(r.step, r.time, list(r.state)) for r in got.where("partition_name = 'p'").orderBy(STEP).collect()] == [(0, 0, [2, 1]), (1, 1, [8, 7]), (2, 2, [5, 4])]
    (tmp_path / "bad.csv").write_text("0,x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|x"):
        readers.read_csv(spark, str(tmp_path / "bad.csv"), 0, {"p": [1]}).collect()
    writers.write(got, "json_log", path=str(tmp_path / "log"))
    back = readers.load(spark, "json_log", path=str(tmp_path / "log"))
    key = lambda df: sorted((r.partition_name, r.step, r.time, tuple(r.state)) for r in df.collect())
    assert key(back) == key(got)
    writers.write(got, "arrow", path=str(tmp_path / "a.arrow"), widths={"p": 2, "q": 1})
    assert key(readers.load(spark, "arrow", path=str(tmp_path / "a.arrow"))) == key(got)
    writers.write(got, "duckdb", path=str(tmp_path / "a.db"), table="rows")
    import duckdb

    with duckdb.connect(str(tmp_path / "a.db")) as con:
        assert con.execute("SELECT count(*) FROM rows").fetchone() == (6,)
    writers.write(got, "parquet", path=str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 6
    writers.write(got, "nil")
    assert writers.condition(got, "every_n_steps", 2).count() == 4 and writers.condition(got, "nil").count() == 0
    hist = readers.replay_history(got.where("partition_name = 'q'"), 2).where("step = 2").orderBy("at").collect()
    assert [r.replay for r in hist] == [[9.0], [6.0]]
    (tmp_path / "bad.log").write_text('{"partition_name": "p", "state": [1], "time": 0}\nnot json\n')
    with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
        readers.read_json_log(spark, str(tmp_path / "bad.log")).collect()


PROGRAM = """
main:
  partitions:
    - {name: y, iteration: {type: wiener_process}, params: {variances: [1.0]}, init_state_values: [0.0]}
  expressions:
    - partition: {name: twice, init_state_values: [0.0], params_from_upstream: {y: {upstream: y}}}
      fields: [{name: v, width: 1}]
      outputs: ["2 * y"]
  simulation:
    termination_condition: {type: number_of_steps, max_steps: 10}
    output_condition: {type: only_given_partitions, partitions: [twice, y]}
run: {mode: ensemble, seeds: [1, 2]}
"""


def test_program(spark, tmp_path):
    p = Program(PROGRAM)
    rows = p.run(spark).collect()
    by = {(r.series_id, r.partition_name, r.step): r.state[0] for r in rows}
    assert len(rows) == 44 and all(by[s, "twice", k] == 2 * by[s, "y", k] for s in (1, 2) for k in range(1, 11))
    assert "y" in p.graph().mermaid()
    for bad in (PROGRAM + "extra: 1\n", PROGRAM.replace("variances", "variances").replace("seeds:", "sedes:"), PROGRAM + "macros: []\n", PROGRAM.replace("init_state_values: [0.0]}", "depth: 3}")):
        with pytest.raises(ProgramError):
            Program(bad)


def test_macros(spark, tmp_path):
    rows = "\n".join(json.dumps({"partition_name": "d", "state": [float(i), 2.5 * i + 1, float(i % 2)], "time": float(i)}) for i in range(60))
    (tmp_path / "d.log").write_text(rows)
    text = f"""
data: {{source: {{type: json_log, path: {tmp_path}/d.log}}}}
macros:
  - {{type: vector_mean, name: m, data: {{partition_name: d, value_indices: [0]}}, kernel: constant, depth: 2}}
  - {{type: vector_variance, name: v, data: {{partition_name: d}}, kernel: {{type: exponential, exponential_weighting_timescale: 5.0}}, depth: 2}}
  - {{type: scalar_regression_stats, name: o, y: {{partition_name: d, value_indices: [1]}}, x: {{partition_name: d, value_indices: [0]}}, intercept: true}}
  - {{type: grouped_aggregation, name: g, data: {{partition_name: d, value_indices: [0]}}, group_by: [{{partition_name: d, value_indices: [2]}}], aggregation: sum, kernel: constant, depth: 1}}
  - {{type: likelihood_comparison, name: l, data: {{partition_name: d, value_indices: [0]}}, likelihood: normal, params: {{mean: [30.0], variance: [100.0]}}, window_depth: 5}}
  - {{type: ensemble_kalman_filter, name: k, data: {{partition_name: d, value_indices: [1]}}, ensemble_size: 10, persistence: 0.9, process_variance: 1.0, observation_noise_variance: 0.5}}
"""
    out = {(r.partition_name, r.step): r.state for r in Program(text).run(spark).collect()}
    assert out["m", 10] == [9.0] and out["o", 59][6:8] == pytest.approx([1.0, 2.5], abs=1e-6) and out["g", 10] == [10.0, 9.0]
    assert len(out["k", 59]) == 2 and len(out["l", 59]) == 1
    live = Program("macros:\n  - {type: evolution_strategy_optimisation, name: e, reward: '-(a[0] - 1) * (a[0] - 1)', initial_mean: [0.0], initial_covariance: [1.0], rounds: 100}\n")
    assert abs(live.run(spark).first().state[0] - 1) < 0.5


def test_streams(spark, tmp_path):
    for i in range(3):
        part = spark.createDataFrame([(u, float(4 * i + k), float(u + k + i)) for u in (1, 2) for k in range(4)], "series_id long, time double, value double")
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    read = lambda: spark.readStream.schema("series_id long, time double, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))

    def collect(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = {(r.series_id, r.time): r["mean"] for r in collect(stateful.rolling_mean(read(), "value", 2), "s1")}
    value = lambda u, t: u + t % 4 + t // 4
    assert len(got) == 24 and got[1, 1.0] == 0.0
    for u in (1, 2):
        for t in range(2, 12):
            assert got[u, float(t)] == pytest.approx(np.mean([value(u, s) for s in range(t - 2, t + 1)]))
    top = {(r.series_id, r.time): list(r.top) for r in collect(stateful.running_top(read(), "value", 2), "s2")}
    assert top[1, 11.0] == [6.0, 5.0]


def test_stdout_prints_every_row(spark, capsys):
    rows = spark.range(1500).selectExpr("0L AS series_id", "'a' AS partition_name", "id AS step", "double(id) AS time", "array(1.0D) AS state")
    writers.write_stdout(rows)
    assert len(capsys.readouterr().out.splitlines()) == 1500
    writers.write_stdout(rows, 10)
    assert len(capsys.readouterr().out.splitlines()) == 10


def test_smc_macro_refuses_priors_that_it_would_not_use(spark):
    from tidewheel.plans.program import MACROS

    prior = {"type": "uniform", "lower": 0.0, "upper": 1.0}
    with pytest.raises(ProgramError, match="one prior"):
        MACROS["smc_inference"](spark, None, {"name": "a", "priors": [prior, prior], "data": [1.0], "likelihood_variance": 1.0, "num_particles": 4, "num_rounds": 1})


def test_streams_are_apart():
    from tidewheel.functions.rng import stream

    paths = [(1,), (1 + 2**32,), ("1",), ("wiener_process_1",), ("wiener_process_2",), ("x" * 90 + "a",), ("x" * 90 + "b",), ("ab", "c"), ("a", "bc"), (0, "a"), (0, 0, "a")]
    assert len({stream(*p).random() for p in paths}) == len(paths)
    assert stream(3, "a").random() == stream(np.int64(3), "a").random()


def test_proposals_stay_inside():
    from tidewheel.operators.inference import propose
    from tidewheel.operators.likelihood import Prior

    g = np.random.default_rng(1)
    x = propose([Prior("uniform", 0.0, 1.0)], 500, g, np.array([-0.25, 0.01, 0.0]))  # a hundredth of its mass is inside
    assert len(x) == 500 and (x >= 0).all() and x.mean() < 0.2  # and not the prior's draws


def test_duckdb_sink(spark, tmp_path):
    import duckdb

    from tidewheel.sources.writers import write_duckdb

    long = spark.createDataFrame([(0, "p", i, float(i), [float(i), 2.0]) for i in range(2500)], "series_id long, partition_name string, step long, time double, state array<double>").repartition(7)
    for rows in (2500, 100):
        write_duckdb(long.limit(rows), str(tmp_path / "x.duckdb"), "t", rows=1000)
        with duckdb.connect(str(tmp_path / "x.duckdb")) as con:
            assert con.execute("SELECT count(*), count(DISTINCT step), sum(state[2]) FROM t").fetchone() == (rows, rows, 2.0 * rows)
