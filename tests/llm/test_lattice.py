import numpy as np
import pytest
from pyspark.sql import types as T

from lendgov.llm import lattice
from lendgov.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, least=0.98):
    """vec_id -> (links, component) from all pairs."""
    sound = []
    for i, (v, e, la) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in e or []], float)
        if la is not None and len(x) and np.isfinite(x).all() and (x != 0).any():
            x = x / np.abs(x).max()
            sound.append((i, la, x / np.linalg.norm(x)))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, la, x) in enumerate(sound):
        for j, lb, y in sound[n + 1:]:
            if la == lb and len(x) == len(y) and float(x @ y) >= least:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least_id = {}
    for i, (v, *_) in enumerate(rows):
        least_id[find(i)] = min(least_id.get(find(i), v), v)
    return sorted((rows[i][0], links[i], least_id[find(i)]) for i in range(len(rows)))


def clusters(seed, n_clusters=25, size=14, noise=0.017, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n_clusters):
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(size):
            out.append(((base + noise * rng.standard_normal(dim)) * rng.uniform(0.5, 2), c % 3))
    return [(i, e.astype(np.float32).tolist(), la) for i, (e, la) in enumerate(out)]


def test_recall_and_no_false_links(spark):
    rows = clusters(1)
    got = {r.vec_id: r for r in lattice.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert sum(w[1] for w in want) > 1000
    assert all(got[v].n_links <= n for v, n, _ in want)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for _, n, _ in want)
    assert sum(got[v].component_id == c for v, _, c in want) >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("block", [2, 16])
def test_blocks_of_a_hot_cell_change_nothing(spark, block):
    rows = clusters(2, n_clusters=2, size=60, noise=0.008)
    a, b = (sorted(map(tuple, lattice.linked(spark.createDataFrame(rows, SCHEMA), block=k).collect())) for k in (1024, block))
    assert a == b and max(r[1] for r in a) > 40


def test_nearest_lattice_point_is_nearest():
    rng = np.random.default_rng(3)
    roots = lattice._roots()
    assert len(np.unique(roots, axis=0)) == 240 and np.allclose((roots ** 2).sum(1), 2)
    x = rng.uniform(-3, 3, (400, 8))
    p = lattice.nearest_e8(x)
    d = ((x - p) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()  # the covering radius of E8 is 1
    assert all((((x - p - r) ** 2).sum(1) >= d - 1e-9).all() for r in roots)
    twice = np.rint(2 * p).astype(int)
    assert np.allclose(twice, 2 * p) and ((twice % 2 == twice[:, :1] % 2).all(1)).all() and (twice.sum(1) % 4 == 0).all()


def test_query_rows(spark):
    got = QUERIES["op8_embedding_dedup"](spark, "/root/testdata/sf0.01").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    assert sorted(zip(got.vec_id, got.n_links, got.component_id)) == brute([(r.vec_id, r.embedding, r.label) for r in rows])
    assert [(f, str(t)) for f, t in got.dtypes.items()] == [("vec_id", "int64"), ("n_links", "int64"), ("component_id", "int64"), ("kept", "bool")]


def test_edges(spark):
    a = [1.0, 0.5, 0.0]
    rows = [(1, a, 1), (2, a, 1), (3, a, 2), (4, [2.0, 1.0, 0.0], 1), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 0.0], 1),
            (8, [float("nan"), 1.0, 0.0], 1), (9, [float("inf"), 1.0, 0.0], 1), (10, a, None), (11, [], 1), (12, [-0.0, 0.0, -0.0], 1),
            (13, [1.0, 0.5, -0.0], 1), (14, [1.0, 0.5], 1), (15, a, 1), (15, a, 1), (16, [1e30, 5e29, 0.0], 1), (17, [1e-30, 5e-31, 0.0], 1)]
    schema = T.StructType([*spark.createDataFrame([], SCHEMA).schema.fields, T.StructField("v", T.StringType()), T.StructField("cells", T.StringType())])
    got = sorted(tuple(r)[:3] for r in lattice.linked(spark.createDataFrame([(*r, "x", "y") for r in rows], schema)).collect())
    assert got == brute(rows)
    assert lattice.linked(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in lattice.linked(spark.createDataFrame([(None, None, None)], SCHEMA)).collect()] == [(None, 0, None, False)]


def test_pairs_at_the_threshold_meet():
    """Pairs with a cosine of just 0.98, the hardest to find, share a cell."""
    rng = np.random.default_rng(5)
    for dim in (16, 64, 256):
        a = rng.standard_normal((3000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        o = rng.standard_normal((3000, dim))
        o -= (o * a).sum(1, keepdims=True) * a
        o /= np.linalg.norm(o, axis=1, keepdims=True)
        b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * o
        cells = [lattice.cells(x, lattice.TABLES, lattice.PROBES, lattice.SCALE, 0.98) for x in (a, b)]
        met = np.array([np.intersect1d(x, y).size > 0 for x, y in zip(*cells)])
        assert met.mean() > 0.99


def test_many_small_groups_and_a_large_one():
    rng = np.random.default_rng(6)
    key = np.array([(g, 0, 0) for g in range(300) for _ in range(rng.integers(1, 6))] + [(999, 0, 0)] * 150, np.int64)
    unit = lattice._unit(rng.standard_normal((len(key), 4)))
    a, b = lattice._compared(unit, key, 0.5)
    got = set(zip(a.tolist(), b.tolist()))
    want = {(i, j) for i in range(len(key)) for j in range(i + 1, len(key)) if (key[i] == key[j]).all() and unit[i] @ unit[j] >= 0.5}
    assert got == want
