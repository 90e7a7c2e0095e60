"""Exact Shapley values of a forest against background rows (E1 for tree models).

The game: a coalition's features come from the explained row, the others from a background row; its value is the
forest's output, averaged over the background. A leaf is reached if every feature on its path is one that agrees with the
path in the row it is taken from. So for one leaf, row and background row three sets matter: features that only the row meets
(they must be in the coalition), those that only the background row meets (they must be out), and those neither meets (the leaf is
never reached). The Shapley value of such a term has a closed form in the sizes of the first two sets.

One pass down a tree gives each leaf a bit pattern of the features that a row violates, for all rows of a block at once, and the same
pass gives the patterns of the background. For a leaf with k features on its path, the terms of all background rows are
summed for each of the 2^k patterns that a row can have (subset sums over bits). Leaves that lie below one node are read as one: the
tables of all of them are added up for each pattern at that node and each outcome of the tests below it, and a row reads its sums from there, once for
each feature and node instead of for each leaf. The work for a row does not grow with the background. Columns that belong to one feature (its dummies) are one player.

What is sent with the tasks is the forest's nodes and the background, both bounded by parameters (trees, depth, ``MAX_BACKGROUND``);
tables exist for one tree at a time. Rows are dealt evenly over all cores first (``prep.spread``): a small file read by one task would
be explained by that task alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel_shap import MAX_BACKGROUND
from .prep import spread

#: Rows that a task explains at once: tables are built once for each block and tree. Rows of a block that go down a tree together.
BLOCK_ROWS, CHUNK_ROWS = 1 << 17, 1 << 14
#: Features on the path to a node and tests below it, up to which the leaves below are read as one: a table has two to this power entries for each feature.
GROUP_BITS = 12
#: Features on one path; a table has two to this power entries for each.
MAX_PATH = 14


@dataclass
class Tree:
    """Nodes by number; a leaf has left -1. A row goes left where its value is at most the threshold, or one of the categories."""

    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    column: list[int] = field(default_factory=list)
    test: list[float | tuple[float, ...]] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        return self._add(-1, -1, -1, 0.0, value)

    def split(self, column: int, test: float | tuple[float, ...], left: int, right: int) -> int:
        return self._add(left, right, column, test, 0.0)

    def _add(self, *node) -> int:
        for values, v in zip((self.left, self.right, self.column, self.test, self.value), node):
            values.append(v)
        return len(self.left) - 1


@dataclass
class Forest:
    """The mean of trees (``root``: each one's first node) over columns; ``players[c]`` is the feature that column c belongs to."""

    trees: list[tuple[Tree, int]]
    players: list[int]
    n_players: int

    @staticmethod
    def goes_left(tree: Tree, at: int, values: np.ndarray) -> np.ndarray:
        return Forest.passes(tree.test[at], values)

    @staticmethod
    def passes(test: float | tuple[float, ...], values: np.ndarray) -> np.ndarray:
        if not isinstance(test, tuple):
            return values <= test
        return values == test[0] if len(test) == 1 else np.isin(values, test)

    @staticmethod
    def longer(path: list[int], player: int) -> list[int]:
        """The path with the player on it; one that is too long is refused."""
        out = path if player in path else [*path, player]
        if len(out) > MAX_PATH:
            raise ValueError(f"a path of more than {MAX_PATH} features")
        return out

    def leaves(self, tree: Tree, root: int, x: np.ndarray) -> Iterator[tuple[float, list[int], np.ndarray]]:
        """(value, features on the path, the ones that each row of ``x`` (columns, rows) violates as bits), leaf by leaf."""
        stack: list[tuple[int, list[int], np.ndarray]] = [(root, [], np.zeros(x.shape[1], np.uint16))]
        while stack:
            at, path, bits = stack.pop()
            if tree.left[at] < 0:
                yield tree.value[at], path, bits
                continue
            goes_left = self.goes_left(tree, at, x[tree.column[at]])
            player = self.players[tree.column[at]]
            longer = self.longer(path, player)
            bit = np.uint16(1 << longer.index(player))
            stack.append((tree.right[at], longer, np.where(goes_left, bits | bit, bits)))
            stack.append((tree.left[at], longer, np.where(goes_left, bits, bits | bit)))

    def output(self, x: np.ndarray) -> np.ndarray:
        """The forest's value of every row of ``x`` (columns, rows): each row goes down its own path only."""
        out = np.zeros(x.shape[1])
        for tree, root in self.trees:
            stack: list[tuple[int, list[int], np.ndarray]] = [(root, [], np.arange(x.shape[1]))]
            while stack:
                at, path, rows = stack.pop()
                if tree.left[at] < 0:
                    out[rows] += tree.value[at]
                    continue
                path = self.longer(path, self.players[tree.column[at]])
                goes_left = self.goes_left(tree, at, x[tree.column[at]][rows]) if len(rows) else np.zeros(0, bool)
                stack.append((tree.right[at], path, rows[~goes_left]))
                stack.append((tree.left[at], path, rows[goes_left]))
        return out / len(self.trees)

    def grouped(self, tree: Tree, root: int, background: np.ndarray):
        """The tree as nested parts: (None, column, test, bit of its player, left, right) of a test, (features on the path, tests below, players, sums) of leaves read as one."""
        known = list(self.leaves(tree, root, background))
        tables: list[np.ndarray] = [np.empty(0)] * len(known)
        for k in {len(path) for _, path, _ in known}:
            own = [i for i, (_, path, _) in enumerate(known) if len(path) == k]
            for i, made in zip(own, shares(k, np.array([known[i][0] for i in own]), np.stack([known[i][2] for i in own]))):
                tables[i] = made
        leaf = iter(tables)  # in the order in which leaves are met below
        inner: dict[int, int] = {}

        def count(at: int) -> int:
            if at not in inner:
                inner[at] = 0 if tree.left[at] < 0 else 1 + count(tree.left[at]) + count(tree.right[at])
            return inner[at]

        def part(at: int, path: list[int]):
            if tree.left[at] >= 0 and len(path) + count(at) > GROUP_BITS:
                player = self.players[tree.column[at]]
                longer = self.longer(path, player)
                return None, tree.column[at], tree.test[at], np.uint16(1 << longer.index(player)), part(tree.left[at], longer), part(tree.right[at], longer)
            tests: list[tuple[int, float | tuple[float, ...]]] = []
            pattern = np.arange(1 << (len(path) + count(at)))  # what the path violates, then the tests below that fail
            sums: dict[int, np.ndarray] = {}

            def below(at: int, known: list[int], violated: np.ndarray) -> None:
                if tree.left[at] < 0:
                    for player, t in zip(known, next(leaf)):
                        sums[player] = sums[player] + t[violated] if player in sums else t[violated]
                    return
                player = self.players[tree.column[at]]
                longer = self.longer(known, player)
                bit, fails = 1 << longer.index(player), pattern >> (len(path) + len(tests)) & 1
                tests.append((tree.column[at], tree.test[at]))
                below(tree.left[at], longer, violated | fails * bit)
                below(tree.right[at], longer, violated | (1 - fails) * bit)

            below(at, path, pattern & ((1 << len(path)) - 1))
            return len(path), tests, list(sums), list(sums.values())

        return part(root, [])

    def explain(self, x: np.ndarray, background: np.ndarray) -> np.ndarray:
        """Shapley values (features, rows) of the rows of ``x`` against those of ``background`` (both: columns, rows)."""
        phi = np.zeros((self.n_players, x.shape[1]))
        x = np.ascontiguousarray(x)
        for tree, root in self.trees:
            whole = self.grouped(tree, root, background)
            for start in range(0, x.shape[1], CHUNK_ROWS):
                own, out = x[:, start:start + CHUNK_ROWS], phi[:, start:start + CHUNK_ROWS]
                stack = [(whole, np.zeros(own.shape[1], np.uint16))]
                while stack:
                    (k, *about), bits = stack.pop()
                    if k is None:
                        column, test, bit, left, right = about
                        goes_left = self.passes(test, own[column])
                        stack.append((right, bits | goes_left * bit))
                        stack.append((left, bits | ~goes_left * bit))
                        continue
                    tests, players, sums = about
                    for i, (column, test) in enumerate(tests):
                        bits = bits | ~self.passes(test, own[column]) * np.uint16(1 << (k + i))
                    at = bits.astype(np.intp)  # once, not for each feature
                    for player, t in zip(players, sums):
                        out[player] += t.take(at)
        return phi / len(self.trees)


def shares(k: int, values: np.ndarray, violated: np.ndarray) -> np.ndarray:
    """For leaves with k features on the path: the share of each feature for every pattern that a row can violate.

    ``values`` of the leaves, ``violated`` (leaves, background rows) as bits. Returns (leaves, k, 2^k).
    """
    n, size = 1 << k, np.array([int(m).bit_count() for m in range(1 << k)])
    # background rows by what they violate (it must come from the row), by how many features that is
    held = np.zeros((len(values), k + 1, n))
    np.add.at(held, (np.arange(len(values))[:, None], size[violated], violated), 1.0 / violated.shape[1])
    for i in range(k):  # sums over subsets
        pair = held.reshape(len(values), k + 1, n >> (i + 1), 2, 1 << i)
        pair[..., 1, :] += pair[..., 0, :]
    f = [math.factorial(i) for i in range(2 * k + 2)]
    inside = np.array([[f[s - 1] * f[t] / f[s + t] if s else 0.0 for t in range(k + 1)] for s in range(k + 1)])
    outside = np.array([[f[s] * f[t - 1] / f[s + t] if t else 0.0 for t in range(k + 1)] for s in range(k + 1)])
    met = np.arange(n)  # what the row meets; the rest must come from the background
    rest = k - size
    absent = -np.einsum("psm,sm->pm", held, outside[:, rest])
    out = np.empty((len(values), k, n))
    for j in range(k):
        has = (met >> j) & 1 == 1
        out[:, j, ~has] = absent[:, ~has]
        needed = held[:, :, has] - held[:, :, met[has] ^ (1 << j)]
        out[:, j, has] = np.einsum("psm,sm->pm", needed, inside[:, rest[has]])
    return (out * values[:, None, None])[:, :, ::-1]  # from what is met to what is violated


def fitted_forest(nodes: DataFrame, players: Sequence[int]) -> Forest:
    """A trained classification forest from its stored nodes (the ``data`` table of a saved Spark model), class 1's share as value.

    At most trees x 2^(depth + 1) rows reach the driver.
    """
    rows = nodes.select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.impurityStats",
                        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories").collect()
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for _, by_id in sorted(trees.items()):
        t, number = Tree(), {}
        for i in sorted(by_id, reverse=True):  # children have higher numbers than their parent
            r = by_id[i]
            if r["leftChild"] < 0:
                stats = r["impurityStats"]
                number[i] = t.leaf(stats[1] / sum(stats))
            else:
                test = r["leftCategoriesOrThreshold"]
                number[i] = t.split(r["featureIndex"], test[0] if r["numCategories"] < 0 else tuple(test), number[r["leftChild"]], number[r["rightChild"]])
        out.append((t, number[min(by_id)]))
    players = list(players)
    return Forest(out, players, max(players) + 1)


def tree_shap(rows: DataFrame, background: DataFrame, keys: Sequence[str], forest: Forest) -> DataFrame:
    """keys, fx, expected_value and phi (array in feature order) of every row of ``rows`` (keys, columns: array<double>).

    ``background`` (columns) has 1 to ``MAX_BACKGROUND`` rows.
    """
    bg = [r["columns"] for r in background.select("columns").limit(MAX_BACKGROUND + 1).collect()]
    if not 0 < len(bg) <= MAX_BACKGROUND:
        raise ValueError(f"the background needs 1 to {MAX_BACKGROUND} rows")
    held = np.array(bg, float).T
    expected = float(forest.output(held).mean())
    shared = rows.sparkSession.sparkContext.broadcast((forest, held))

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        own, known = shared.value
        got = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        x = got.column(got.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1).T
        phi = np.ascontiguousarray(own.explain(x, known).T)
        n, m = phi.shape
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m), pa.int32()), pa.array(phi.ravel()))
        return pa.record_batch([*got.columns[:-1], pa.array(own.output(x)), lists], names=[*got.schema.names[:-1], "fx", "phi"])

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block(waiting)
                waiting, n = [], 0
        if n:
            yield block(waiting)

    given = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return spread(rows.select(*keys, "columns")).mapInArrow(run, f"{given}, fx double, phi array<double>").select(
        *keys, "fx", F.lit(expected).alias("expected_value"), "phi")
