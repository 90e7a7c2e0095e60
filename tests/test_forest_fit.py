"""F1 to F8: forests of large tables are fitted level by level, by Spark's rules, without a weight for each row and tree."""

import numpy as np
import pandas as pd
import pytest

from lendgov.operators import forest_fit as FF
from lendgov.operators import training as TR


def rows_of(spark, n, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float), "c": rng.choice(["u", "v", "w"], n)})
    pdf["label"] = ((pdf.a > 0.3) ^ (pdf.c == "u") ^ (pdf.b == 2)).astype(int)
    return pdf, spark.createDataFrame(pdf)


def test_a_large_forest_does_not_keep_a_weight_for_each_row_and_tree(spark, monkeypatch):
    pdf, df = rows_of(spark, 3000, 1)
    monkeypatch.setattr(TR, "GROWN_PAIRS", 3000 * 12)
    monkeypatch.setattr(TR.RandomForestClassifier, "_fit", lambda self, rows: pytest.fail("Spark's own fit"))
    monkeypatch.setattr(FF, "STORED_ROWS", 100)
    model = TR.fit(df, ["a", "b"], ["c"], TR.forest(num_trees=12, max_depth=6))
    assert TR.is_forest(model) and model.stages[-1].getNumTrees == 12 and model.stages[-1].getMaxDepth() == 6
    p = TR.positive_probability(model, df, ["label"]).toPandas()
    assert ((p.p >= 0.5) == (p.label == 1)).mean() > 0.9
    # the form that explanations read gives the model's own probabilities
    forest = TR.forest_of(model, ["a", "b"], ["c"])
    x = np.stack([r[0] for r in TR.vectors(model, df, ["label"]).select("columns").collect()]).T
    assert sorted(forest.output(x)) == pytest.approx(sorted(p.p), abs=1e-12)
    # every tree is grown on all rows, each with a weight of mean 1
    weights = [t._call_java("rootNode").impurityStats().count() for t in model.stages[-1].trees]
    assert all(abs(w - 3000) < 5 * 3000 ** 0.5 for w in weights) and len(set(weights)) > 1


def test_a_fit_with_the_same_rows_is_the_same(spark, monkeypatch):
    _, df = rows_of(spark, 500, 2)
    monkeypatch.setattr(TR, "GROWN_PAIRS", 0)
    one, two = (TR.fit(df.coalesce(1), ["a", "b"], ["c"], TR.forest(num_trees=4, max_depth=3)).stages[-1].toDebugString.split("\n", 1)[1] for _ in range(2))
    assert one == two


def test_small_forests_are_fitted_as_before(spark):
    from pyspark.ml import Pipeline
    _, df = rows_of(spark, 300, 3)
    got = TR.fit(df, ["a", "b"], ["c"], TR.forest(num_trees=3, max_depth=3)).stages[-1]
    want = Pipeline(stages=[*TR.preprocessing(["a", "b"], ["c"], n_train=300), TR.forest(num_trees=3, max_depth=3)]).fit(df).stages[-1]
    assert got.toDebugString.split("\n", 1)[1] == want.toDebugString.split("\n", 1)[1]


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    found = rng.integers(0, 9, (5, 3, 12))
    found[:, 1:] = found[:, :1]  # each column holds the same rows
    for k in (1, 2):
        found[:, k] = found[:, 0].reshape(5, 6, 2)[:, rng.permutation(6)].reshape(5, 12)
    bins = np.full((5, 3), 6)
    j, cut, gain, impurity, whole, left = FF.best_splits(found, bins, 1)
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum() if c.sum() else 0.0
    for node in range(5):
        best = -1.0
        for c in range(3):
            h = found[node, c].reshape(6, 2)
            for b in range(5):
                lo, hi = h[:b + 1].sum(0), h[b + 1:].sum(0)
                if lo.sum() and hi.sum():
                    best = max(best, gini(h.sum(0)) - (lo.sum() * gini(lo) + hi.sum() * gini(hi)) / h.sum())
        assert gain[node] == pytest.approx(best) and impurity[node] == pytest.approx(gini(whole[node]))
        assert left[node].tolist() == found[node, j[node]].reshape(6, 2)[:cut[node] + 1].sum(0).tolist()


def test_nodes_that_nothing_helps_are_leaves():
    pure = np.zeros((1, 1, 4), int)
    pure[0, 0] = [3, 0, 4, 0]
    assert FF.best_splits(pure, np.array([[2]]), 1)[2].tolist() == [0.0]
    assert FF.between([1.0, 2.0, 5.0], [1, 1, 1], 31) == [1.5, 3.5]
    assert FF.between([1.0], [9], 31) == []
    assert FF.between(list(range(100)), [1] * 100, 3) == [24.5, 49.5, 74.5]


def test_labels_other_than_0_and_1_are_refused(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), "u", i % 3) for i in range(30)], "a double, c string, label int")
    monkeypatch.setattr(TR, "GROWN_PAIRS", 0)
    with pytest.raises(Exception, match="labels are 0 or 1"):
        TR.fit(df, ["a"], ["c"], TR.forest(num_trees=2, max_depth=2))


def test_a_row_weighs_one_on_average():
    assert len(FF._WEIGHT) == 1 << 16
    assert FF._WEIGHT.mean() == pytest.approx(1.0, abs=1e-3) and FF._WEIGHT.var() == pytest.approx(1.0, abs=2e-3)
