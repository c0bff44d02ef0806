"""Exact cases of windows, grouping, regression, filters, quantiles and the expression language."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions.expr import ExpressionError, evaluate, to_column
from tidewheel.operators import accumulate as acc
from tidewheel.operators import inference, kernels, likelihood, rolling
from tidewheel.operators.grouping import discover_groups, grouped_aggregation
from tidewheel.operators.regression import ols
from tidewheel.series import ID, STEP, DataRef, to_long


@pytest.fixture(scope="module")
def three(spark):
    rows = [(0, i, 1234.0 + i, 1.0 + i, 4.0 + i, 7.0 + i, a, b, c) for i, (a, b, c) in enumerate([(1.0, 2.0, 4.0), (1.0, 2.0, 4.0), (2.0, 3.0, 4.0)])]
    return spark.createDataFrame(rows, "series_id long, step long, time double, a double, b double, c double, g0 double, g1 double, g2 double")


def rows(df, *cols):
    return [[r[c] for c in cols] for r in df.orderBy(ID, STEP).collect()]


@pytest.mark.parametrize("kernel", [kernels.Constant(), kernels.Product(kernels.Constant(), kernels.Binned([1.0] * 9, 1.0)), kernels.Exponential(1e12)])
def test_rolling(three, kernel):
    values = ["a", "b", "c"]
    assert rows(rolling.rolling_mean(three, values, 2, kernel), "a_mean", "b_mean", "c_mean") == [[0, 0, 0], [0, 0, 0], pytest.approx([2, 5, 8])]
    assert rows(rolling.rolling_variance(three, values, 2, kernel), "a_var", "b_var", "c_var") == [[0, 0, 0], [0, 0, 0], pytest.approx([1, 1, 1])]
    got = rows(rolling.rolling_covariance(three, values, 2, kernel), *[f"cov_{i}_{j}" for i in range(3) for j in range(3)])
    assert got == [[0] * 9, [0] * 9, pytest.approx([1, 1, 1, 0, 1, 1, 0, 0, 1])]


def test_deep_and_short_frames_agree(spark):
    df = spark.range(120).select((F.col("id") % 3).alias(ID), F.floor(F.col("id") / 3).alias(STEP), F.floor(F.col("id") / 3).cast("double").alias("time"), F.sin("id").alias("x"))
    short = rows(rolling.rolling_mean(df, ["x"], 20, kernels.Exponential(5.0)), "x_mean")
    before, rolling.UNROLLED = rolling.UNROLLED, 0
    try:
        deep = rows(rolling.rolling_mean(df, ["x"], 20, kernels.Exponential(5.0)), "x_mean")
    finally:
        rolling.UNROLLED = before
    assert np.allclose(short, deep)


def test_grouped_max(three):
    got = grouped_aggregation(three, ["a", "b", "c"], [["g0", "g1", "g2"]], "max", precision=1, depth=2, instantaneous=True).orderBy(STEP, "group_idx").collect()
    assert [r.key[0] for r in got[:4]] == [1, 2, 3, 4]
    assert [r.value for r in got] == [0, 0, 0, 0, 2, 5, 0, 8, 0, 3, 6, 9]


def test_group_discovery(spark):
    data = [[1.2, 2.02, 4.004], [1.1, 2.03, 4.0], [2.01, 3.1, 4.1]]
    df = spark.createDataFrame([(0, i, float(i), *r) for i, r in enumerate(data)], "series_id long, step long, time double, x double, y double, z double")
    assert discover_groups(df, [["x", "y", "z"]], 1).count() == 6 and discover_groups(df, [["x", "y", "z"]], 2).count() == 8
    two = spark.createDataFrame([(0, 0, 0.0, 1.0, 1.0, 10.0, 20.0), (0, 1, 1.0, 2.0, 2.0, 10.0, 20.0)], "series_id long, step long, time double, a0 double, a1 double, b0 double, b1 double")
    got = discover_groups(two, [["a0", "a1"], ["b0", "b1"]], 3).orderBy("group_idx").collect()
    assert [tuple(r.key) for r in got] == [(1, 10), (2, 10), (1, 20), (2, 20)]


def test_ols_line(spark):
    df = spark.range(51).select(F.lit(0).alias(ID), F.col("id").alias(STEP), F.col("id").cast("double").alias("time"), F.col("id").cast("double").alias("x"), (2.5 * F.col("id") + 1).alias("y"))
    for window in (None, 10):
        out = rows(ols(df, "y", "x", intercept=True, window=window), "alpha", "beta", "sigma2")
        assert out[0] == [0, 0, 0] and out[-1] == pytest.approx([1, 2.5, 0], abs=1e-6)
    assert rows(ols(df, "y", "x"), "n")[-1] == [50]


def test_discounted_and_cumulative(spark):
    n = 1500
    df = spark.range(n).select(F.lit(0).alias(ID), F.col("id").alias(STEP), F.col("id").cast("double").alias("time"), F.cos("id").alias("x"))
    for g in (0.9, 0.1, 1.0):
        y, want = 0.0, []
        for i in range(n):
            y = math.cos(i) + g * y if i else 0.0
            want.append(y)
        assert np.allclose([r[0] for r in rows(acc.discounted_cumulative(df, "x", g), "x_dis")], want)
    top = rows(acc.running_top(df, "x", [], 3), "top")
    assert [e.key for e in top[-1][0]] == sorted((math.cos(i) for i in range(1, n)), reverse=True)[:3] and top[0][0] == []


def test_data_ref(three):
    long = to_long(three, {"test": ["a", "b", "c"]})
    assert DataRef("test").names(3) == ["test 0", "test 1", "test 2"] and DataRef("test", [0, 2]).names(3) == ["test 0", "test 2"]
    assert DataRef("test", is_time=True).names(3) == ["time"]
    assert rows(DataRef("test", [0, 2], (1, 3)).read(long, 3), "test 0", "test 2") == [[2, 8], [3, 9]]


def test_enkf():
    assert np.allclose(inference.enkf_analysis(np.array([[-1.0], [1.0]]), [3.0], np.array([1.0]), [0]), [[5 / 3], [7 / 3]])
    got = inference.enkf_analysis(np.array([[-2.0, -4], [0, 0], [2, 4]]), [6.0], np.array([1.0]), [0])
    assert np.allclose(got, [[4.4, 8.8], [4.8, 9.6], [5.2, 10.4]])


def test_posterior_and_quantiles(spark):
    df = spark.createDataFrame([(1.0, 2.0, -1.0), (3.0, 4.0, -1.0), (5.0, 6.0, -1.0)], "p double, q double, l double")
    r = likelihood.posterior_moments(df, ["p", "q"], "l").first()
    assert (r.mean_0, r.mean_1) == (3, 4) and r.log_marginal == pytest.approx(-1.0)
    vals = spark.createDataFrame([("k", float(i), 1.0) for i in range(1, 6)], "k string, v double, w double")
    q = likelihood.weighted_quantiles(vals, "v", "w", [0.1, 0.5, 0.9], ["k"]).first()
    assert (q.q0, q.q1, q.q2) == (1, 3, 5)


def test_expression_values(spark):
    cases = {"a % b": 1, "!a": 0, "!(a - 7)": 1, "2 + 3 * 4": 14, "a - b - b": 1, "1 && 5": 1, "clamp(a, 0, 5)": 5, "clamp(a, 8, 10)": 8, "min(a, b)": 3, "max(a, b)": 7,
             "-a * 2": -14, "1 < 2 == 1": 1, "scan(0, i, acc, 42, acc + 1)": 42, "1 / 0 > 5": 1, "each(3, i, i * a)[2]": 14}
    row = spark.range(1).select(F.lit(7.0).alias("a"), F.lit(3.0).alias("b"))
    for text, want in cases.items():
        assert evaluate(text, {"a": 7, "b": 3})[0] == want, text
        assert row.select(to_column(text, {"a": "a", "b": "b"})).first()[0] == want, text
    assert evaluate("0 && nope", {})[0] == 0 and evaluate("1 || nope", {})[0] == 1
    v = [2.0, 7.0, 3.0, 9.0, 4.0]
    vec = spark.createDataFrame([(v, [-1.0, 1.0, 2.0, 5.0])], "v array<double>, w array<double>")
    for text, names, want in (
        ("scan(5, i, m, v[0], max(m, v[i]))", {"v": v}, [9]), ("(w > 0) && (w < 3)", {"w": [-1, 1, 2, 5]}, [0, 1, 1, 0]),
        ("slice(scan(5, i, acc, 0, concat(acc, acc[i] + v[i])), 0, 5)", {"v": v}, [0, 2, 9, 12, 21]), ("each(5, i, sum(slice(v, 0, i)))", {"v": v}, [0, 2, 9, 12, 21]),
        ("where(w > 0, w * 2, 0 - w)", {"w": [-1, 1, 2, 5]}, [1, 2, 4, 10]),
    ):
        assert evaluate(text, names).tolist() == want, text
        got = vec.select(to_column(text, {}, {k: k for k in names})).first()[0]
        assert (got if isinstance(got, list) else [got]) == want, text
    for bad in ("a +", "foo(a)", "a[9]", "normal(0, 1)", "nope", "a b"):
        with pytest.raises(ExpressionError):
            evaluate(bad, {"a": 1.0}, np.random.default_rng(0))


def test_likelihoods_against_numpy(spark):
    row = spark.range(1).select(F.lit(2.0).alias("x"))
    pairs = [
        (likelihood.Poisson([3.0]), 2 * math.log(3) - 3 - math.lgamma(3)), (likelihood.Normal([1.0], [4.0]), -0.5 * (math.log(2 * math.pi * 4) + 0.25)),
        (likelihood.Normal([1.0], covariance=[4.0]), -0.5 * (math.log(2 * math.pi * 4) + 0.25)), (likelihood.Gamma([4.0], [8.0]), 2 * math.log(0.5) - math.lgamma(2) + math.log(2) - 1.0),
    ]
    for like, want in pairs:
        assert row.select(like.loglike([F.col("x")])).first()[0] == pytest.approx(want, abs=1e-10)
    assert likelihood.wishart_loglike(np.array([[2.0]]), np.array([[1.0]]), 3.0) == pytest.approx(0.5 * math.log(2) - 1 - 1.5 * math.log(2) - math.lgamma(1.5))
    got = spark.range(1).select(likelihood.digamma(F.lit(1.0))).first()[0]
    assert got == pytest.approx(-0.5772156649015329, abs=1e-10)


def test_covariance_of_whole_embeddings(spark, sf):
    import duckdb
    import numpy as np

    import __spark_entry__ as entry

    got = entry.queries()["embedding_rolling_cov_whole"](spark, sf).toPandas()
    rows = duckdb.sql(f"SELECT label, embedding FROM '{sf}/embeddings.parquet' ORDER BY label, vec_id").df()
    assert len(got) == len(rows) * 64 * 65 // 2
    got = {k: g.sort_values(["i", "j"])["cov"].to_numpy() for k, g in got.groupby(["series_id", "step"])}
    for label, g in rows.groupby("label"):
        x = np.stack(g.embedding.to_list()).astype("f8")
        for t in range(len(x)):
            want = np.cov(x[t - 6 : t + 1].T)[np.triu_indices(64)] if t >= 6 else 0.0
            np.testing.assert_allclose(got[label, t], want, atol=6e-5)


def test_covariance_pairs_leave_nulls_out(spark):
    from tidewheel.operators.kernels import Constant
    from tidewheel.operators.rolling import rolling_covariance, rolling_covariance_pairs

    rows = [(s, t, float(t), None if (t + s) % 3 == 0 else float(t * t % 7), None if t % 4 == 1 else float(t * 3 % 5)) for s in (1, 2) for t in range(12)]
    df = spark.createDataFrame(rows, "series_id long, step long, time double, a double, b double")
    want = {(r.series_id, r.step, i, j): r[f"cov_{i}_{j}"] for r in rolling_covariance(df, ["a", "b"], 2, Constant()).collect() for i, j in ((0, 0), (0, 1), (1, 1))}
    got = {tuple(r)[:4]: r["cov"] for r in rolling_covariance_pairs(df, ["a", "b"], 2).collect()}
    assert got.keys() == want.keys() and None in want.values()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9), k


def test_decimal_weights_are_summed_exactly(spark):
    df = spark.range(7).select(F.lit(0).alias(ID), F.col("id").alias(STEP), F.col("id").cast("double").alias("time"), F.lit(1.5).alias("x"), F.when(F.col("id") < 6, 1.0).otherwise(2.0).alias("g"))
    kernel = kernels.Binned([1.0] + [0.09] * 9, 1.0)
    assert kernel.decimals == 2 and kernels.Binned([1 / 3], 1.0).decimals is None and kernels.Binned([1e13], 1.0).decimals is None
    got = rows(grouped_aggregation(df, ["x"], [["g"]], "count", depth=6, groups=[[1]], kernel=kernel), "value")
    assert got[-1] == [0.54]  # 0.5399999999999999 as a sum of doubles


def test_binned_mean_matches_sql_on_ties(spark):
    import duckdb

    from tidewheel.catalog import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    want = {(a, b, int(c)): v for a, b, c, v in con.sql(ORACLE["grouped_binned_mean"]).fetchall()}
    got = {(r[ID], r[STEP], r["key"]): r["value"] for r in QUERIES["grouped_binned_mean"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
