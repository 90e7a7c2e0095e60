import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lendgov.llm import importance
from lendgov.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(importance.WORD)


def plain_buckets(text, orders=(1, 1), buckets=10_000):
    words = WORD.findall((text or "").encode().lower().decode())
    grams = [" ".join(words[i:i + k]) for k in range(orders[0], orders[1] + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % buckets for g in grams)


def plain(docs, target, orders=(1, 1), buckets=10_000, min_words=20, percent=10, seed=2024):
    """(doc_id, n_features, weight, score, rank), row by row."""
    own = [(i, *plain_buckets(t, orders, buckets)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, b in own:
        s.update(b)
    for x in target:
        t.update(plain_buckets(x, orders, buckets)[1])
    top = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * top[0] / (float(s[b] + 1) * top[1]))) for b in range(buckets)]
    rows = []
    for i, n, b in own:
        u = (int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        w = sum(gain[k] * c for k, c in b.items())
        rows.append([i, sum(b.values()), w, w + math.floor(-1000 * math.log(-math.log(u))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in rows)


def test_query_equals_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = Counter(tuple(r) for r in QUERIES["op12_importance_resampling"](spark, SF).collect())
    assert got == plain(docs, target)


@pytest.mark.parametrize("how", [{}, {"orders": (1, 3), "buckets": 500, "percent": 35, "min_words": 3}, {"orders": (2, 2)}])
def test_edges_and_other_parameters(edge, how):
    docs = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    target = edge.where("doc_id > 150").select("text")
    got = Counter(tuple(r) for r in importance.digest(importance.scored(importance.placed(edge), target, **how)).collect())
    assert got == plain(docs, [r.text for r in target.collect()], **how)


def test_empty_tables(spark, edge, empty, nulls):
    assert importance.scored(importance.placed(empty), edge.select("text")).count() == 0
    rows = importance.scored(importance.placed(nulls), empty.select("text")).collect()
    assert len(rows) == 3 and all(r.n_features == 0 and r.weight == 0 and r["rank"] is None for r in rows)


def test_a_hot_row_is_drawn_as_often_as_it_occurs(spark):
    docs = spark.range(0, 3000, 1, 8).selectExpr("if(id % 3 = 0, 1L, id + 10) as doc_id", "if(id % 3 = 0, repeat('aim ', 30), repeat(concat('w', id, ' '), 25)) as text")
    target = "aim " * 200_000
    got = importance.drawn(docs, spark.createDataFrame([(target,)], "text string"), percent=40)
    assert got.columns == docs.columns
    want = plain([tuple(r) for r in docs.collect()], [target], percent=40)
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, *_, rank in want.elements() if rank is not None)
    assert got.where("doc_id = 1").count() == 1000


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB9é日 \x00\x7f-\n_", max_size=400), st.integers(1, 3), st.integers(0, 2))
def test_pieces_give_the_buckets_of_the_whole_text(text, least, more):
    orders, old = (least, least + more), importance.PIECE
    try:
        importance.PIECE = 7
        n, got = importance.Windows(orders, 97)(text)
    finally:
        importance.PIECE = old
    assert (n, Counter(got.tolist())) == plain_buckets(text, orders, 97)


def test_gains_favour_the_target():
    g = importance.gains(np.array([10, 0, 5]), np.array([0, 10, 5]))
    assert g[0] < 0 < g[1] and g[0] == math.floor(1000 * math.log(1 * 18 / (11 * 18)))
    rng = random.Random(1)
    s, t = ([rng.randrange(100) for _ in range(50)] for _ in range(2))
    assert importance.gains(np.array(s), np.array(t)).dtype == np.int64
