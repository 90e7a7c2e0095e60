"""The exact ball index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendgov.operators import retrieval as RT


def frame(spark, x, at=0, name="doc_id"):
    return spark.createDataFrame([(at + i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, unit array<double>")


def brute(q, x, k, skip=None):
    s = q @ x.T
    out = []
    for i, row in enumerate(s):
        order = sorted((j for j in range(len(x)) if skip is None or j != skip[i]), key=lambda j: (-round(row[j], 12), j))[:k]
        out.append([round(float(row[j]), 9) for j in order])
    return out


def unit(a):
    return a / np.linalg.norm(a, axis=1, keepdims=True)


@pytest.mark.parametrize("pivots,block_rows", [(1, 7), (16, 50), (300, 10_000)])
def test_equals_all_pairs(spark, pivots, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12))
    x = unit(np.concatenate([c + 0.2 * rng.normal(size=(60, 12)) for c in centres] + [np.repeat(rng.normal(size=(1, 12)), 120, 0)]))  # with a group of equal vectors
    index = RT.BallIndex.build(frame(spark, x), n_pivots=pivots, block_rows=block_rows)
    top = index.topk(frame(spark, x[::9], 0, "query_id").withColumn("query_id", F.col("query_id") * 9), k=4).orderBy("query_id", "rank").collect()
    got = {}
    for r in top:
        assert r.doc_id != r.query_id
        got.setdefault(r.query_id, []).append(round(r.score, 9))
    want = brute(x[::9], x, 4, list(range(0, len(x), 9)))
    assert [got[i * 9] for i in range(len(want))] == [pytest.approx(w, abs=1e-8) for w in want]


def test_clustered_vectors_are_not_all_scored(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = unit(np.concatenate([c + 0.05 * rng.normal(size=(50, 16)) for c in centres]))
    index = RT.BallIndex.build(frame(spark, x), n_pivots=64)
    queries = frame(spark, x[::50], 100_000, "query_id")
    scored, visits = index.scored(queries, 3, False)
    assert scored.count() < 0.2 * len(x) * 40
    assert visits.count() == 40 and visits.agg(F.max("blocks")).first()[0] < len(index.blocks)
    # more queries than one batch holds at once, and none
    assert index.topk(frame(spark, np.repeat(x[:7], 30, 0), 0, "query_id"), 2, False).count() == 420
    assert index.topk(queries.limit(0), 3).count() == 0


def test_few_or_no_vectors(spark):
    x = unit(np.random.default_rng(1).normal(size=(3, 4)))
    assert RT.topk_inner_product(frame(spark, x, 0, "query_id"), frame(spark, x), k=5).count() == 6
    assert RT.topk_inner_product(frame(spark, x, 0, "query_id"), frame(spark, x).limit(0), k=5).count() == 0


def test_topk_makes_no_row_for_each_pair(spark):
    """scores come from matrix products of whole chunks; a chunk hands on a query's k best only, ties by the smaller id."""
    rng = np.random.default_rng(9)
    x = unit(np.concatenate([rng.normal(size=(700, 16)), np.repeat(rng.normal(size=(2, 16)), 150, 0)]))  # no bound rules anything out; two groups of copies
    index = RT.BallIndex.build(frame(spark, x), n_pivots=8, block_rows=100)
    some = list(range(0, len(x), 10))
    queries = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in some], "query_id long, unit array<double>")
    one, two = index._passes(queries, 3, True, keep=3)
    chunks = 1 + max(c for cs in index.blocks["chunks"] for c in cs)
    rows = one.unionByName(two)
    assert rows.count() <= len(some) * chunks * 3 < len(some) * len(x) / 4
    got = {}
    for r in index.topk(queries, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for i in some:
        exact = np.zeros(len(x))
        for a, b in zip(x[i], x.T):
            exact += a * b
        want = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-exact[j], j))[:3]
        assert got[i] == [(j, exact[j]) for j in want]


def test_topk_of_repeated_and_null_ids(spark):
    """Repeated ids are rows of their own, none of them the query's; null ids are no query's other document."""
    v = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]
    docs = spark.createDataFrame([(5, v[0])] * 9 + [(6, v[0]), (7, v[1]), (7, v[1]), (None, v[0]), (8, v[2])], "doc_id long, unit array<double>")
    queries = spark.createDataFrame([(5, v[0]), (9, v[1])], "query_id long, unit array<double>")
    top = RT.topk_inner_product(queries, docs, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in top] == [(5, 6), (5, 7), (5, 7), (9, 7), (9, 7), (9, 8)]
    mine = RT.topk_inner_product(queries.where("query_id = 5"), docs, 2, exclude_self=False).orderBy("rank").collect()
    assert [r.doc_id for r in mine] == [None, 5]
