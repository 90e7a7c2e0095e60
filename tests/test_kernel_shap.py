import itertools
import math

import numpy as np

from pyspark.sql import functions as F

from lendgov.operators import kernel_shap as KS


def exact_shapley(f, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Brute-force interventional Shapley values of one row (test reference, small M)."""
    m = len(x)
    phi = np.zeros(m)

    def v(sub):
        mixed = background.copy()
        idx = list(sub)
        mixed[:, idx] = x[idx]
        return float(np.mean([f(r) for r in mixed]))

    for j in range(m):
        others = [i for i in range(m) if i != j]
        for k in range(m):
            for sub in itertools.combinations(others, k):
                wgt = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                phi[j] += wgt * (v(sub + (j,)) - v(sub))
    return phi


def _np_model(r):
    z = 0.5 * r[0] - 1.0 * r[1] + 0.3 * r[0] * r[2] + 0.2 * r[3]
    return 1 / (1 + np.exp(-z))


def test_exact_at_small_m(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5, 4))
    bg = rng.normal(size=(6, 4))
    feats = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    bgdf = spark.createDataFrame([(100 + i, *map(float, r)) for i, r in enumerate(bg)],
                                 "id long, a double, b double, c double, d double")
    out = KS.kernel_shap(rows, bgdf, "id", feats, lambda r: 1 / (1 + np.exp(-(0.5 * r[0] - r[1] + 0.3 * r[0] * r[2] + 0.2 * r[3]))), n_coalitions=None).toPandas()
    for i in range(len(x)):
        want = exact_shapley(_np_model, x[i], bg)
        got = np.array(out[out.id == i].phi.iloc[0])
        assert np.allclose(got, want, atol=1e-9)
        # additivity
        assert abs(got.sum() - (out[out.id == i].fx.iloc[0] - out[out.id == i].expected_value.iloc[0])) < 1e-9


def test_sampled_additivity(spark):
    rng = np.random.default_rng(8)
    feats = [f"f{i}" for i in range(10)]
    x = rng.normal(size=(3, 10))
    bg = rng.normal(size=(4, 10))
    sch = "id long, " + ", ".join(f"{f} double" for f in feats)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], sch)
    bgdf = spark.createDataFrame([(10 + i, *map(float, r)) for i, r in enumerate(bg)], sch)

    def model(v):
        return 1 / (1 + np.exp(-sum(0.1 * (k + 1) * v[k] for k in range(10))))

    out = KS.kernel_shap(rows, bgdf, "id", feats, model, n_coalitions=200).toPandas()
    for i in range(3):
        g = out[out.id == i]
        assert abs(sum(g.phi.iloc[0]) - (g.fx.iloc[0] - g.expected_value.iloc[0])) < 1e-9


def test_additive_equals_exact_and_sampled_is_near(spark):
    rng = np.random.default_rng(3)
    m = 6
    x, bg = rng.normal(size=(4, m)), rng.normal(size=(20, m))
    frame = lambda a, at: spark.createDataFrame([(at + i, list(map(float, r))) for i, r in enumerate(a)], "id long, parts array<double>")
    feats = [f"f{i}" for i in range(m)]
    exact = KS.additive_shap(frame(x, 0), frame(bg, 100), "id", feats, 0.3, n_coalitions=None).orderBy("id").collect()
    near = KS.additive_shap(frame(x, 0), frame(bg, 100), "id", feats, 0.3, n_coalitions=2000).orderBy("id").collect()
    for i in range(len(x)):
        want = exact_shapley(lambda r: 1 / (1 + np.exp(-(r.sum() + 0.3))), x[i], bg)
        assert np.allclose(exact[i].phi, want, atol=1e-9) and np.allclose(near[i].phi, want, atol=0.01)
        assert abs(sum(near[i].phi) - (near[i].fx - near[i].expected_value)) < 1e-9


def test_background_is_bounded(spark):
    import pytest
    rows = spark.range(KS.MAX_BACKGROUND + 1).select("id", F.array(F.lit(1.0)).alias("parts"))
    with pytest.raises(ValueError):
        KS.additive_shap(rows, rows, "id", ["a"], 0.0)


def _additive(x, bg, bias, z, w):
    """Reference: every drawn coalition, one exponential for each background row."""
    prob = lambda v: 1 / (1 + np.exp(-v))
    p, fx, base = KS.solve_matrix(z, w), prob(x.sum() + bias), prob(bg.sum(1) + bias).mean()
    v = prob((1 - z) @ bg.T + bias + (z @ x)[:, None]).mean(1)
    phi = p @ v - base * p.sum(1) - (fx - base) * (p @ z[:, -1])
    return np.append(phi, fx - base - phi.sum())


def test_additive_shap_spreads_one_file_and_keeps_its_values(spark):
    rng = np.random.default_rng(3)
    x, bg = rng.normal(size=(400, 6)) * 3, rng.normal(size=(9, 6))
    x[0, 1], x[1, 2] = 900.0, -900.0  # beyond what exponentials can be multiplied for
    frame = lambda v: spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "id long, parts array<double>")
    out = KS.additive_shap(frame(x).coalesce(1), frame(bg), "id", list("abcdef"), 0.3, n_coalitions=200)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) > 1
    z, w = KS.coalitions(6, 200)
    assert len(got) == 400
    for r in got:
        assert np.allclose(r["phi"], _additive(x[r["id"]], bg, 0.3, z, w), atol=1e-10)
