"""Forest Shapley values against exact enumeration."""

import itertools
import math
import random

import numpy as np
import pytest

from lendgov.operators import tree_shap as TS


def random_forest(rng, n_trees, depth, n_columns, players, numeric):
    """``numeric``: how many columns are split by threshold; the rest by categories."""
    trees = []
    for _ in range(n_trees):
        t = TS.Tree()

        def grow(d):
            if d == 0 or rng.random() < 0.2:
                return t.leaf(rng.random())
            c = rng.randrange(n_columns)
            left, right = grow(d - 1), grow(d - 1)
            return t.split(c, rng.choice([-1.0, 0.0, 0.5]) if c < numeric else (float(rng.randrange(2)),), left, right)

        trees.append((t, grow(depth)))
    return TS.Forest(trees, players, max(players) + 1)


def value(forest, column):
    """One row's output by walking each tree."""
    total = 0.0
    for t, at in forest.trees:
        while t.left[at] >= 0:
            v, test = column[t.column[at]], t.test[at]
            at = t.left[at] if (v in test if isinstance(test, tuple) else v <= test) else t.right[at]
        total += t.value[at]
    return total / len(forest.trees)


def exact(forest, x, background):
    """Shapley values of one row from all coalitions."""
    m = forest.n_players

    def worth(s):
        return np.mean([value(forest, [xv if p in s else bv for xv, bv, p in zip(x, b, forest.players)]) for b in background])

    phi = []
    for j in range(m):
        rest = [p for p in range(m) if p != j]
        phi.append(sum(math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (worth({*s, j}) - worth(set(s)))
                       for k in range(m) for s in itertools.combinations(rest, k)))
    return phi


@pytest.mark.parametrize("seed", range(12))
def test_equals_exact_enumeration(seed):
    rng = random.Random(seed)
    # the last three columns are the dummies of one feature
    forest = random_forest(rng, 4, 1 + seed % 5, 6, [0, 1, 2, 3, 3, 3], 3)
    draw = lambda n: np.array([[rng.choice([-2.0, -1.0, 0.0, 0.3, 0.5, 1.0]) for _ in range(3)] + [float(rng.randrange(2)) for _ in range(3)] for _ in range(n)])
    x, bg = draw(7), draw(9)
    phi = forest.explain(x.T, bg.T)
    for i, row in enumerate(x):
        assert forest.output(x.T)[i] == pytest.approx(value(forest, row))
        assert phi[:, i] == pytest.approx(exact(forest, row, bg), abs=1e-12)
    assert phi.sum(0) == pytest.approx(forest.output(x.T) - forest.output(bg.T).mean(), abs=1e-12)


def test_a_forest_of_leaves_explains_nothing():
    t = TS.Tree()
    forest = TS.Forest([(t, t.leaf(0.25))], [0, 1], 2)
    assert forest.output(np.zeros((2, 3))).tolist() == [0.25] * 3
    assert not forest.explain(np.zeros((2, 3)), np.ones((2, 4))).any()


def test_long_paths_are_refused():
    t = TS.Tree()
    at = t.leaf(1.0)
    for c in range(TS.MAX_PATH + 1):
        at = t.split(c, 0.0, at, t.leaf(0.0))
    forest = TS.Forest([(t, at)], list(range(TS.MAX_PATH + 1)), TS.MAX_PATH + 1)
    with pytest.raises(ValueError):
        forest.output(np.zeros((TS.MAX_PATH + 1, 1)))


def test_rows_of_one_file_are_explained_by_several_tasks(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    f = random_forest(rng, 4, 4, 5, [0, 1, 2, 3, 3], 3)
    rows = [(i, [rng.choice([-2.0, -0.5, 0.2, 1.0]) for _ in range(3)] + [float(rng.randrange(2)) for _ in range(2)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, columns array<double>")
    out = TS.tree_shap(df.coalesce(1), df.limit(7), ["id"], f).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in out}) > 1
    assert sorted(r["id"] for r in out) == list(range(300))
    for r in out:
        assert r["fx"] == pytest.approx(value(f, rows[r["id"]][1]), abs=1e-12)
        assert sum(r["phi"]) == pytest.approx(r["fx"] - r["expected_value"], abs=1e-12)
