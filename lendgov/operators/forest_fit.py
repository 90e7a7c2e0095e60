"""Fitting a random forest on large tables (M7): Spark's rules, level by level, on rows held as bytes.

Spark's own fit keeps a weight for each row and tree (2.4 kB a row for 300 trees) and adds every row to histograms of all trees at
once, which lie far apart in memory. Here a row is one byte for each column: its bin and its label. Rows lie in blocks; a task takes one tree after
the other through a block, so what it reads and adds to stays close, and a row's weight in a tree is drawn anew in each pass from the block's seed.

The rules are Spark's: candidate thresholds at even shares of the rows, or between all values where there are few; Poisson(1) weights; a
random subset of columns (square root) for each node; the greatest Gini gain; leaves of one prediction under one parent are merged. The
result is Spark's own model class, read from the form in which Spark saves it. A pass sends histograms for each tree, never rows; one row for each node reaches the driver.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path
from . import prep

#: Rows of a stored block, and rows that a task takes through the trees at once.
STORED_ROWS, BLOCK_ROWS = 1 << 12, 1 << 17
#: Even shares of the rows at which a column's values are looked at for its thresholds, and the accuracy of that look.
SHARES, SHARE_ACCURACY = 4096, 10_000
#: Bytes of an Arrow batch: stored blocks are large rows.
BATCH_BYTES = 1 << 25
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Weights that a row has in a tree, by 16 random bits: Poisson(1).
_WEIGHT = np.repeat(np.arange(9, dtype=np.uint8), np.diff(np.round(65536 * np.cumsum([0.0] + [math.exp(-1) / math.factorial(k) for k in range(8)] + [1.0]).clip(0, 1)).astype(int)))


def suits(est: RandomForestClassifier) -> bool:
    """Whether the estimator asks for what is done here: bagged trees by Gini gain over columns of up to 128 bins."""
    return (est.getBootstrap() and est.getSubsamplingRate() == 1.0 and est.getImpurity() == "gini" and est.getFeatureSubsetStrategy() == "sqrt" and est.getNumTrees() > 1
            and est.getMaxBins() <= 128 and est.getMaxDepth() <= 14 and est.getMinWeightFractionPerNode() == 0.0 and not est.isDefined(est.weightCol) and not est.isDefined(est.thresholds))


@contextmanager
def _small_batches(spark: SparkSession):
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def between(values: Sequence[float], counts: Sequence[int], most: int) -> list[float]:
    """Thresholds for sorted distinct values: between all of them, or the ``most`` that cut the rows most evenly."""
    middle = [(a + b) / 2 for a, b in zip(values, values[1:])]
    if len(middle) <= most:
        return middle
    stride = sum(counts) / (most + 1)
    out, upto, target = [], counts[0], stride
    for i in range(1, len(values)):
        before, upto = upto, upto + counts[i]
        if abs(before - target) < abs(upto - target):
            out.append(middle[i - 1])
            target += stride
    return out[:most]


def thresholds(rows: DataFrame, numeric: Sequence[int], max_bins: int) -> dict[int, np.ndarray]:
    """Candidate thresholds of each numeric column of ``columns``, from all rows."""
    if not numeric:
        return {}
    shares = F.split(F.lit(",".join(str(i / SHARES) for i in range(SHARES + 1))), ",").cast("array<double>")  # one literal
    looked = rows.agg(*[F.percentile_approx(F.col("columns")[c], shares, SHARE_ACCURACY).alias(f"c{c}") for c in numeric]).first()
    out = {}
    for c in numeric:
        x = np.array(looked[f"c{c}"] or [], float)
        values, counts = np.unique(x[np.isfinite(x)], return_counts=True)
        out[c] = np.array(between(values.tolist(), counts.tolist(), max_bins - 1))
    return out


def _stored(rows: DataFrame, cuts: list[np.ndarray], tasks: int) -> DataFrame:
    """(block, n, keys): rows as bytes, column by column: twice the bin, plus the label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            if not np.isin(label, (0.0, 1.0)).all():
                raise ValueError("a forest's labels are 0 or 1")
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            keys = np.empty((len(cuts), batch.num_rows), np.uint8)
            for c, cut in enumerate(cuts):
                keys[c] = np.searchsorted(cut, x[:, c]) * 2  # at most the threshold: to the left of it
            keys += label.astype(np.uint8)
            for at in range(0, batch.num_rows, STORED_ROWS):
                part = keys[:, at:at + STORED_ROWS]
                yield pa.record_batch([pa.array([part.shape[1]], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["n", "keys"])

    blocks = rows.select("label", "columns").mapInArrow(run, "n int, keys binary")
    return blocks.repartition(tasks).withColumn("block", F.monotonically_increasing_id()).checkpoint()


class Level:
    """The nodes of one depth that may be split: for each tree their numbers (root 1, children 2i and 2i + 1) and columns to look at."""

    def __init__(self, size: int, column: np.ndarray, cut: np.ndarray, open_nodes: list[list[int]], subsets: list[np.ndarray]):
        self.column, self.cut, self.open, self.subsets = column, cut, open_nodes, subsets
        self.size = size

    def walk(self, tree: int) -> tuple[list[int], list[bool]]:
        """For each node number the place of its histogram or -1, and whether such a node lies below it."""
        place, holds = [-1] * self.size, [False] * self.size
        for i, node in enumerate(self.open[tree]):
            place[node] = i
            while node and not holds[node]:
                holds[node] = True
                node //= 2
        return place, holds

    def add(self, found: list[np.ndarray], keys: np.ndarray, seed: int, block: int) -> None:
        """Adds a block's rows (columns, rows) to every tree's histograms (node, column of its subset, key)."""
        n = keys.shape[1]
        for tree, into in enumerate(found):
            if not len(into):
                continue
            bits = np.random.SFC64([seed, block, tree]).random_raw(-(-n // 4)).view(np.uint16)[:n]
            weight = _WEIGHT.take(bits)
            stack = [(1, np.flatnonzero(weight != 0))]
            place, holds = self.walk(tree)
            column, cut, subsets, width = self.column[tree].tolist(), self.cut[tree].tolist(), self.subsets[tree].tolist(), into.shape[2]
            while stack:
                node, rows = stack.pop()
                at = place[node]
                if at >= 0:
                    w = weight.take(rows).astype(float)
                    for j, c in enumerate(subsets[at]):
                        into[at, j] += np.bincount(keys[c].take(rows), weights=w, minlength=width).astype(into.dtype)
                    continue
                left = keys[column[node]].take(rows) <= cut[node]
                if holds[2 * node]:
                    stack.append((2 * node, rows.take(np.flatnonzero(left))))
                if holds[2 * node + 1]:
                    stack.append((2 * node + 1, rows.take(np.flatnonzero(~left))))


def _histograms(blocks: DataFrame, level: Level, width: int, seed: int) -> DataFrame:
    """(tree, found): each task's histograms of each tree with open nodes."""
    shared = blocks.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        found = [np.zeros((*s.shape, width), np.int64 if s.shape[0] < 16 else np.int32) for s in own.subsets]
        waiting, n, first = [], 0, None

        def flush():
            own.add(found, np.concatenate(waiting, axis=1), seed, first)

        for batch in batches:
            for size, keys, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                first = block if first is None else first
                waiting.append(np.frombuffer(keys.as_buffer(), np.uint8).reshape(-1, size))
                n += size
                if n >= BLOCK_ROWS:
                    flush()
                    waiting, n, first = [], 0, None
        if n:
            flush()
        for tree, f in enumerate(found):
            if f.any():
                f = f.astype(np.min_scalar_type(f.max()))  # most are small numbers
                yield pa.record_batch([pa.array([tree], pa.int32()), pa.array([f.dtype.str]), pa.array([f.tobytes()], pa.binary())], names=["tree", "kind", "found"])

    return blocks.select("n", "keys", "block").mapInArrow(run, "tree int, kind string, found binary")


def best_splits(found: np.ndarray, bins: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """For each node (node, column, key) the best column of its subset, the bin that ends the left side, gain, impurity, and class counts of the node and its left side.

    ``bins`` (node, column): how many bins the column has. A node that no split helps has gain 0.
    """
    n, m, _ = found.shape
    upto = found.reshape(n, m, -1, 2).cumsum(2).astype(float)
    whole = upto[:, 0, -1]
    gini = lambda c, s: 1.0 - (c * c).sum(-1) / np.where(s > 0, s * s, 1.0)
    total = whole.sum(-1)
    impurity = np.where(total > 0, gini(whole, total), 0.0)
    right = whole[:, None, None] - upto
    a, b = upto.sum(-1), right.sum(-1)
    gain = impurity[:, None, None] - (a * gini(upto, a) + b * gini(right, b)) / np.maximum(total, 1.0)[:, None, None]
    gain[(a < least) | (b < least) | (np.arange(gain.shape[2]) >= bins[:, :, None] - 1)] = -1.0
    best = gain.reshape(n, -1).argmax(1)
    j, cut = np.divmod(best, gain.shape[2])
    i = np.arange(n)
    return j, cut, np.maximum(gain[i, j, cut], 0.0), impurity, whole, upto[i, j, cut]


def _splits(histograms: DataFrame, level: Level, bins: np.ndarray, least: int) -> list:
    """One row for each open node: tree, place, column, cut, gain, impurity, counts of the node and of its left side."""
    shared = histograms.sparkSession.sparkContext.broadcast((level.subsets, bins))

    def run(parts: pa.Table) -> pa.Table:
        subsets, n_bins = shared.value
        tree = parts.column("tree")[0].as_py()
        columns = subsets[tree]
        found = np.zeros(1, np.int64)
        for kind, held in zip(parts.column("kind").to_pylist(), parts.column("found")):
            found = found + np.frombuffer(held.as_buffer(), kind)
        found = found.reshape(*columns.shape, -1)
        j, cut, gain, impurity, whole, left = best_splits(found, n_bins[columns], least)
        i = np.arange(len(columns))
        return pa.table({"tree": pa.array(np.full(len(i), tree, np.int32)), "place": pa.array(i.astype(np.int32)), "col": pa.array(columns[i, j].astype(np.int32)), "cut": pa.array(cut.astype(np.int32)),
                         "gain": gain, "impurity": impurity, "n0": whole[:, 0], "n1": whole[:, 1], "l0": left[:, 0], "l1": left[:, 1]})

    return histograms.groupBy("tree").applyInArrow(run, "tree int, place int, col int, cut int, gain double, impurity double, n0 double, n1 double, l0 double, l1 double").collect()


def _tree_nodes(known: dict[int, tuple], cuts: list[np.ndarray], binary: set[int]) -> list[tuple]:
    """A tree's nodes in preorder: (counts, column or -1, test, gain, right child). ``known``: number -> (counts, split or None), split: (column, bin, gain)."""
    leaf: dict[int, bool] = {}
    said = lambda node: known[node][0][1] > known[node][0][0]
    for node in sorted(known, reverse=True):  # children first; leaves of one prediction under one parent are merged
        left, right = 2 * node, 2 * node + 1
        leaf[node] = known[node][1] is None or (leaf[left] and leaf[right] and said(left) == said(right))
    out: list[tuple] = []

    def write(node: int) -> int:
        at = len(out)
        out.append(())
        counts, split = known[node]
        if leaf[node]:
            out[at] = (counts, -1, 0.0, -1.0, -1)
            return at
        c, cut, gain = split
        write(2 * node)
        out[at] = (counts, c, 0.0 if c in binary else float(cuts[c][cut]), gain, write(2 * node + 1))
        return at

    write(1)
    return out


def _node_table(trees: list[list[tuple]], binary: set[int]) -> pa.Table:
    """Nodes in the form in which Spark saves a forest's."""
    nodes = [node for nodes in trees for node in nodes]
    counts, column, test, gain, right = (np.array(x) for x in zip(*nodes))
    inner, total = column >= 0, counts.sum(1)
    number = np.concatenate([np.arange(len(nodes)) for nodes in trees])
    lists = lambda widths, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]), pa.int32()), pa.array(values, pa.float64()))
    whole = lambda x: pa.array(x, pa.int32())
    split = pa.StructArray.from_arrays([whole(column), lists(inner, test[inner]), whole(np.where(np.isin(column, list(binary)), 2, -1))],
                                       names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    data = {"id": whole(number), "prediction": pa.array((counts[:, 1] > counts[:, 0]).astype(float)), "impurity": pa.array(1.0 - (counts ** 2).sum(1) / np.maximum(total ** 2, 1.0)),
            "impurityStats": lists(np.full(len(nodes), 2), counts.ravel()), "rawCount": pa.array(total.astype(np.int64)), "gain": pa.array(gain.astype(float)),
            "leftChild": whole(np.where(inner, number + 1, -1)), "rightChild": whole(right), "split": split}
    return pa.table({"treeID": whole(np.repeat(np.arange(len(trees)), [len(nodes) for nodes in trees])), "nodeData": pa.StructArray.from_arrays(list(data.values()), names=list(data))})


def _saved(spark: SparkSession, est: RandomForestClassifier, trees: list[list[tuple]], n_columns: int, binary: set[int]) -> RandomForestClassificationModel:
    """The model that Spark reads from nodes in the form in which it saves its own."""
    path = checkpoint_path(spark, f"forest-fit-{uuid.uuid4().hex}")
    given, default = ({p.name: v for p, v in m.items()} for m in (est._paramMap, est._defaultParamMap))
    about = lambda kind, uid, params, **more: json.dumps({
        "class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
        "paramMap": params(given), "defaultParamMap": params(default), **more})
    of_tree = lambda m: {k: v for k, v in m.items() if k not in ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")}
    spark.createDataFrame([(about("RandomForestClassificationModel", est.uid, dict, numFeatures=n_columns, numClasses=2, numTrees=len(trees)),)], "value string") \
        .coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(t, about("DecisionTreeClassificationModel", f"dtc_{uuid.uuid4().hex[:12]}", of_tree), 1.0) for t in range(len(trees))], "_1 int, _2 string, _3 double") \
        .coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(_node_table(trees, binary)).coalesce(1).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def fit_forest(data: DataFrame, est: RandomForestClassifier, n: int) -> RandomForestClassificationModel:
    """The forest of ``est`` over all ``n`` rows of ``data`` (its features and label columns), fitted level by level."""
    spark = data.sparkSession
    name = est.getFeaturesCol()
    attrs = data.schema[name].metadata["ml_attr"]
    n_columns, binary = attrs["num_attrs"], {a["idx"] for a in attrs["attrs"].get("binary", [])}
    rows = data.select(F.col(est.getLabelCol()).cast("double").alias("label"), vector_to_array(name).alias("columns"))
    with _small_batches(spark):
        found = thresholds(rows, [c for c in range(n_columns) if c not in binary], est.getMaxBins())
        cuts = [np.array([0.5]) if c in binary else found[c] for c in range(n_columns)]
        bins = np.array([len(c) + 1 for c in cuts])
        tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n // prep.SPREAD_ROWS)))
        blocks = _stored(rows, cuts, tasks)
        return _saved(spark, est, _grown(blocks, est, cuts, bins, binary), n_columns, binary)


def _grown(blocks: DataFrame, est: RandomForestClassifier, cuts: list[np.ndarray], bins: np.ndarray, binary: set[int]) -> list[list[tuple]]:
    seed, n_trees, depth = est.getSeed() % (1 << 63), est.getNumTrees(), est.getMaxDepth()
    m = math.ceil(math.sqrt(len(bins)))
    rng = np.random.default_rng([seed, n_trees])
    size = 1 << depth
    column, cut = np.zeros((n_trees, size), np.int16), np.zeros((n_trees, size), np.int16)
    known: list[dict[int, tuple]] = [{} for _ in range(n_trees)]
    open_nodes = [[1] for _ in range(n_trees)]
    for d in range(depth):
        subsets = [np.stack([rng.choice(len(bins), m, replace=False) for _ in nodes]).astype(np.int16) if nodes else np.zeros((0, m), np.int16) for nodes in open_nodes]
        level = Level(size, column, cut, open_nodes, subsets)
        following: list[list[int]] = [[] for _ in range(n_trees)]
        for r in sorted(_splits(_histograms(blocks, level, 2 * int(bins.max()), seed), level, bins, est.getMinInstancesPerNode())):
            t, node = r["tree"], open_nodes[r["tree"]][r["place"]]
            if not (r["gain"] > 0 and r["gain"] >= est.getMinInfoGain()):
                known[t][node] = ((r["n0"], r["n1"]), None)
                continue
            known[t][node] = ((r["n0"], r["n1"]), (r["col"], r["cut"], r["gain"]))
            column[t, node], cut[t, node] = r["col"], 2 * r["cut"] + 1
            for child, counts in ((2 * node, (r["l0"], r["l1"])), (2 * node + 1, (r["n0"] - r["l0"], r["n1"] - r["l1"]))):
                known[t][child] = (counts, None)
                if d + 1 < depth and min(counts) > 0:
                    following[t].append(child)
        open_nodes = following
        if not any(open_nodes):
            break
    return [_tree_nodes(k, cuts, binary) for k in known]
