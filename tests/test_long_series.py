"""Series cut into chunks, folds of a series, draws on whole batches, and cut playouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.rng import Draws
from tidewheel.operators import accumulate as acc
from tidewheel.operators.inference import fit_mean
from tidewheel.operators.kernels import Constant, Exponential
from tidewheel.operators.likelihood import Wishart, wishart_loglike
from tidewheel.operators.rolling import rolling_mean, rolling_variance
from tidewheel.operators.search import Search, TicTacToe, progress_scores, self_play, winner_scores
from tidewheel.series import ID, STEP, TIME, folded, in_chunks, to_long_series, to_series


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def raw(spark):
    """Series 1 is long with ties in time, 2 short, null of middling length, 3 of one time only."""
    g, out = np.random.default_rng(0), []
    for series, n in ((1, 400), (2, 5), (None, 90), (3, 60)):
        for k in range(n):
            t = 7.0 if series == 3 else float(int(g.exponential(30)))
            out.append((series, t, len(out), float(g.integers(-50, 50))))
    return spark.createDataFrame(out, "s long, t double, id long, v double").repartition(5)


def numbered(raw, make, **more):
    return make(raw, F.col("s"), ["t", "id"], F.col("t"), {"v": F.col("v")}, **more)


@pytest.mark.parametrize("most", [1, 16, 100, 10_000])
def test_numbers_of_long_series(raw, most):
    assert rows(numbered(raw, to_long_series, rows=most)) == rows(numbered(raw, to_series))


def test_long_series_of_nothing_and_without_times(spark, raw):
    assert numbered(raw.limit(0), to_long_series).count() == 0
    bare = raw.withColumn("t", F.when(F.col("id") % 3 > 0, F.col("t")))
    assert rows(numbered(bare, to_long_series, rows=16)) == rows(numbered(bare, to_series))


@pytest.mark.parametrize("depth,size", [(3, 7), (5, 5), (0, 9), (2, 1000)])
def test_chunks_change_nothing(raw, depth, size):
    df = numbered(raw, to_series)
    for op in (
        lambda x: rolling_mean(x, ["v"], depth, Constant()), lambda x: rolling_mean(x, ["v"], depth, Exponential(5.0)), lambda x: rolling_variance(x, ["v"], depth, Constant()),
        lambda x: acc.lagged(x, {"w": "v"}, max(depth, 0)) if depth else x,
    ):
        a, b = (x.orderBy(F.col(ID).asc_nulls_first(), STEP).toPandas() for x in (op(df), in_chunks(df, depth, op, size)))
        assert list(a.columns) == list(b.columns) and len(a) == len(b)
        np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9, atol=1e-9)


def test_a_chunk_holds_its_frame(raw):
    with pytest.raises(ValueError):
        in_chunks(numbered(raw, to_series), 6, lambda x: x, 5)


def test_sums_in_blocks(raw):
    df = numbered(raw, to_series)
    for size in (1, 7, 1000):
        assert rows(acc.cumulative(df, ["v"], 2.0, rows=size)) == rows(acc.cumulative(df, ["v"], 2.0))


def test_folds_see_a_series_in_order(raw):
    df = numbered(raw, to_series)

    def start(series):
        seen = []

        def fold(step, v):
            assert step == len(seen)
            seen.append(v)
            return sum(seen), float("nan") if series is None else float(series)

        return fold

    got = folded(df.repartition(3), ["v"], start, {"total": T.DoubleType(), "who": T.DoubleType()})
    want = acc.cumulative(df.withColumn("v", F.col("v")), ["v"])
    first = {r[ID]: r["v"] for r in df.where(F.col(STEP) == 0).collect()}
    a = {(r[ID], r[STEP]): r["total"] for r in got.collect()}
    b = {(r[ID], r[STEP]): r["v_cum"] + first[r[ID]] for r in want.collect()}
    assert a == pytest.approx(b)
    assert folded(df.limit(0), ["v"], start, {"total": T.DoubleType(), "who": T.DoubleType()}).count() == 0


def test_mean_fit_by_steps(raw):
    df = numbered(raw, to_series)
    got = {}
    for r in fit_mean(df, ["v"], [4.0], 3, learning_rate=1.0, descent_steps=2).orderBy(STEP).collect():
        got.setdefault(r[ID], []).append((r["v"], r["fit_v"]))
    for series in got.values():
        m = 0.0
        for k, (_, fit) in enumerate(series):
            if k >= 3:
                mean = np.mean([x for x, _ in series[k - 2 : k + 1]])
                for _ in range(2):
                    m -= 1.0 / 4.0 * (m - mean)
            assert fit == pytest.approx(m, abs=1e-9)


def test_draws():
    n = 100_000
    keys, at = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, n), np.arange(n)
    full = lambda v: np.full(n, float(v))

    def near(x, mean, var):
        assert abs(x.mean() - mean) < 6 * (var / n) ** 0.5 and abs(x.var() / var - 1) < 0.1

    for a in (0.3, 1.0, 5.5):
        near(np.exp(Draws(keys).log_gamma(full(a), at)), a, a)
    near(Draws(keys).beta(full(0.5), full(2), at), 0.2, 0.16 / 3.5)
    for k, p in ((7, 0.9), (40, 0.25), (1000, 0.01)):
        x = Draws(keys).binomial(full(k), full(p), at)
        near(x, k * p, k * p * (1 - p))
        assert x.min() >= 0 and x.max() <= k and (x == np.floor(x)).all()
    for rate in (0.4, 12.0, 300.0):
        near(Draws(keys).poisson(full(rate), at), rate, rate)
    assert (Draws(keys).poisson(full(0), at) == 0).all() and (Draws(keys).binomial(full(9), full(1), at) == 9).all()
    assert np.isnan(Draws(keys).poisson(full(np.nan), at)).all() and np.isnan(Draws(keys).binomial(full(3), full(np.nan), at)).all()
    # a row's draw does not depend on the others
    rates = np.random.default_rng(2).uniform(0, 99, n)
    assert (Draws(keys).poisson(rates, at)[500:600] == Draws(keys[500:600]).poisson(rates[500:600], np.arange(100))).all()
    for bad in (lambda d: d.poisson(full(-1), at), lambda d: d.binomial(full(2), full(1.5), at), lambda d: d.log_gamma(full(-2), at)):
        with pytest.raises(ValueError):
            bad(Draws(keys))


def test_wishart_of_a_stack(spark):
    scale = [2.0, 0.5, 0.5, 1.0]
    df = spark.createDataFrame([(0, [1.0, 0.2, 0.2, 3.0]), (1, None), (2, [4.0, -1.0, -1.0, 2.0])], "k int, x array<double>")
    got = {r["k"]: r["l"] for r in df.select("k", Wishart(scale, 5.0).loglike(F.col("x")).alias("l")).collect()}
    one = lambda v: float(wishart_loglike(np.array(v).reshape(2, 2), np.array(scale).reshape(2, 2), 5.0))
    assert got[0] == pytest.approx(one([1.0, 0.2, 0.2, 3.0])) and got[2] == pytest.approx(one([4.0, -1.0, -1.0, 2.0]))
    assert got[1] is None or np.isnan(got[1])


def test_scores_of_ends_and_cuts():
    assert winner_scores(1, 3, True) == (0, 1, 0) and winner_scores(-1, 2, True) == (0, 0) and winner_scores(0, 2, False) is None
    assert progress_scores(lambda s, p: [0.25, None][p], None, 2) == (0.25, 0)
    assert progress_scores(lambda s, p: 0.0, None, 2) is None and progress_scores(lambda s, p: None, None, 2) is None


def test_a_cut_playout_scores_nothing():
    g, start = np.random.default_rng(0), (0,) * 9
    assert Search(TicTacToe(), rollout_steps=2).rollout(start, g) is None
    marks = lambda s, p: s.count(p + 1) / 9
    assert Search(TicTacToe(), rollout_steps=3, progress=marks).rollout(start, g) == (2 / 9, 1 / 9)
    search = Search(TicTacToe(), simulations=30, rollout_steps=0, depth=2)
    _, visits = search.run(start, g)
    assert sum(visits.values()) == 30 and not any(n.wins for ns in search.tree.children.values() for n in ns)


def test_the_tree_goes_on(spark):
    g, env = np.random.default_rng(0), TicTacToe()
    search = Search(env, simulations=100)
    action, visits = search.run(env.start(), g)
    after = env.apply(env.start(), action)
    search.advance(action, after)
    assert search.tree.state == after and search.tree.visits == visits[action]
    _, more = search.run(after, g)
    assert sum(more.values()) >= 100
    search.advance(99, (1,) * 9)
    assert search.tree.visits == 0
    games = self_play(spark, TicTacToe, 2, keep=True, simulations=30).collect()
    assert all(5 <= r["n_moves"] <= 9 for r in games)
