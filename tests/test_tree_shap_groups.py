"""the leaves below a node are read from one table, with the values that they have one by one."""

import random

import numpy as np
import pytest

from lendgov.operators import tree_shap as TS
from test_tree_shap import exact, random_forest


def parts(whole):
    return parts(whole[4]) + parts(whole[5]) if whole[0] is None else 1


@pytest.mark.parametrize("bits", [0, 3, 5, 12])
def test_leaves_read_as_one_give_the_exact_values(bits, monkeypatch):
    monkeypatch.setattr(TS, "GROUP_BITS", bits)
    monkeypatch.setattr(TS, "CHUNK_ROWS", 4)
    rng = random.Random(bits)
    forest = random_forest(rng, 3, 5, 6, [0, 1, 2, 3, 3, 3], 3)
    draw = lambda n: np.array([[rng.choice([-2.0, -1.0, 0.0, 0.3, 0.5, 1.0]) for _ in range(3)] + [float(rng.randrange(2)) for _ in range(3)] for _ in range(n)])
    x, bg = draw(11), draw(7)
    phi = forest.explain(x.T, bg.T)
    for i, row in enumerate(x):
        assert phi[:, i] == pytest.approx(exact(forest, row, bg), abs=1e-12)


def test_a_tree_of_many_leaves_is_read_from_few_tables():
    rng, tree = random.Random(1), TS.Tree()

    def grow(d):
        return tree.leaf(rng.random()) if d == 0 else tree.split(rng.randrange(10), rng.choice([-1.0, 0.0, 0.5]), grow(d - 1), grow(d - 1))

    root = grow(7)
    forest = TS.Forest([(tree, root)], list(range(10)), 10)
    bg = np.array([[rng.choice([-2.0, 0.2, 1.0]) for _ in range(10)] for _ in range(9)]).T
    leaves = len(list(forest.leaves(tree, root, bg)))
    assert leaves == 128 and parts(forest.grouped(tree, root, bg)) * 3 <= leaves


def test_tests_of_several_categories():
    t = TS.Tree()
    forest = TS.Forest([(t, t.split(0, (1.0, 3.0), t.leaf(1.0), t.leaf(0.0)))], [0], 1)
    assert forest.explain(np.array([[0.0, 1.0, 2.0, 3.0]]), np.array([[0.0]])).tolist() == [[0.0, 1.0, 0.0, 1.0]]
