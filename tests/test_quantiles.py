import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from lendgov.functions.quantiles import multi_quantiles, quantiles


def _np_q(vals, p):
    return float(np.quantile(np.asarray(vals, dtype=float), p))  # linear interpolation


def test_global_matches_numpy_small_accuracy(spark):
    # accuracy 50 with 20k rows forces the bracket path (n > 4 * accuracy)
    rng = np.random.default_rng(1)
    x = rng.normal(size=20000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    out = quantiles(df, "x", [0.1, 0.5, 0.9], accuracy=50).collect()[0]
    for p, name in [(0.1, "x_q10"), (0.5, "x_q50"), (0.9, "x_q90")]:
        assert abs(out[name] - _np_q(x, p)) < 1e-12


def test_grouped_with_ties_and_nulls(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 4, size=12000)
    x = rng.integers(0, 30, size=12000).astype(float)  # heavy ties
    x[::17] = np.nan
    pdf = pd.DataFrame({"g": g, "x": x})
    df = spark.createDataFrame(pdf).selectExpr("g", "CASE WHEN isnan(x) THEN NULL ELSE x END AS x")
    out = multi_quantiles(df, [("x", 0.25, "a"), ("x", 0.75, "b")], keys=["g"], accuracy=100).toPandas()
    for _, r in out.iterrows():
        vals = pdf[(pdf.g == r.g) & pdf.x.notna()].x
        assert abs(r.a - _np_q(vals, 0.25)) < 1e-12
        assert abs(r.b - _np_q(vals, 0.75)) < 1e-12


def test_hot_group(spark):
    # one group holds most rows; result still exact
    g = np.r_[np.zeros(30000, dtype=int), np.arange(1, 101)]
    x = np.r_[np.linspace(0, 1, 30000), np.arange(100) * 1.0]
    pdf = pd.DataFrame({"g": g, "x": x})
    out = quantiles(spark.createDataFrame(pdf), "x", [0.5], keys=["g"], accuracy=100).toPandas()
    hot = out[out.g == 0].iloc[0]
    assert abs(hot.x_q50 - _np_q(x[:30000], 0.5)) < 1e-12
    assert len(out) == 101


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_property_exact(spark, vals, p):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = quantiles(df, "x", [p], accuracy=10).collect()[0][0]
    assert abs(got - _np_q(vals, p)) < 1e-9


def test_spark_percentile_agrees(spark):
    df = spark.range(0, 5001).selectExpr("CAST(id * 7 % 1013 AS DOUBLE) AS x")
    ours = quantiles(df, "x", [0.9], accuracy=100).collect()[0][0]
    ref = df.selectExpr("percentile(x, 0.9)").collect()[0][0]
    assert abs(ours - ref) < 1e-9


def test_many_distinct_values_with_a_coarse_sketch(spark):
    """1e6 distinct values, accuracy 100: one round and two rounds give the exact answer; two leave a small bracket."""
    import numpy as np
    from pyspark.sql import functions as F
    df = spark.range(1_000_000, numPartitions=8).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("x"))
    x = (np.arange(1_000_000) * 7919 % 1_000_003).astype(float)
    for rounds in (1, 2):
        got = multi_quantiles(df, [("x", p, f"q{i}") for i, p in enumerate((0.1, 0.5, 0.9))], accuracy=100, rounds=rounds).first()
        assert [got.q0, got.q1, got.q2] == [np.quantile(x, p) for p in (0.1, 0.5, 0.9)]


def test_small_groups_at_every_size(spark):
    import numpy as np
    rows = [(n, float(v)) for n in range(1, 40) for v in np.random.default_rng(n).permutation(n) ** 2]
    probs = (0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0)
    df = spark.createDataFrame(rows, "k int, x double")
    for rounds in (1, 2):
        out = multi_quantiles(df, [("x", p, f"q{i}") for i, p in enumerate(probs)], ["k"], accuracy=50, rounds=rounds)
        for r in out.collect():
            x = [v for n, v in rows if n == r.k]
            assert np.allclose([r[f"q{i}"] for i in range(len(probs))], np.quantile(x, probs)), r.k
