import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lendgov.llm import simhash
from lendgov.llm.components import connected_components
from lendgov.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, k=3):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, prints):
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    u = sorted(set(prints))
    for i, a in enumerate(u):
        for b in u[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    least = {}
    for d, p in zip(ids, prints):
        least[find(p)] = min(least.get(find(p), d), d)
    return [least[find(p)] for p in prints]


def test_fingerprint_equals_definition():
    rng = random.Random(1)
    for text in (None, "", "  ", "One", "One two", "one TWO three", "Ä ö Ü A", "\x1c a\x85b c", *(" ".join(rng.choices("abcdef", k=n)) for n in (4, 9, 50))):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_query_equals_brute_force(spark):
    got = QUERIES["op6_simhash_dedup"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")
    prints = [slow_fingerprint(docs.text[i]) for i in got.doc_id]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == slow_components(got.doc_id.tolist(), prints)


@pytest.mark.parametrize("hot_key", [1, 4, 64])
def test_links_reach_what_all_pairs_reach(spark, hot_key):
    rng = random.Random(hot_key)
    prints = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        prints |= {base, *(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(12))}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.linked_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp bigint"), hot_key=hot_key)
    for r in links.collect():
        assert hot_key < 64 or ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
    root = {r.node: r.root for r in connected_components(links).collect()}
    want = slow_components(signed, prints)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(root.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_ring_filter_is_complete_and_its_budgets_prune():
    ring, budgets = simhash._ring(9), simhash._budgets(9, 2)
    assert sum(n for _, n in ring) == 64 and budgets == [(4, 0), (8, 1), (9, 2)]
    rng = np.random.default_rng(3)

    def passes(diff):
        return any(all(bin(diff & simhash._mask(ring, s, length) & (1 << 64) - 1).count("1") <= most for length, most in budgets) for s in range(9))

    for n in (0, 1, 2):
        for _ in range(300):
            assert passes(sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    assert sum(passes(sum(1 << int(b) for b in rng.choice(64, 12, replace=False))) for _ in range(300)) < 3


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 70)] + [(200, 300 + i) for i in range(50)] + [(5, 5), (None, 3), (900, 901), (901, 900)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(71)) and all(got[300 + i] == 200 for i in range(50)) and got[901] == got[900] == 900
    assert 5 in got and None not in got


def test_edges(edge, empty, nulls):
    got = simhash.near_duplicates(edge).toPandas()
    assert len(got) == edge.count()
    blank = got[got.fp == 0]
    assert len(blank) == 4 and set(blank.component_id) == {1}
    assert (got[got.doc_id == 7].component_id == 7).all()
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(nulls).toPandas().component_id.isna().all()
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(7) == 1 and ids.count(1) == 1 and 2 not in ids
    assert ids.count(None) == 1  # the null id whose text is near no other
    assert simhash.keep_first(empty).count() == 0 and simhash.keep_first(nulls).count() == 1
    unnamed = edge.where("doc_id = 4 or doc_id > 210").withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_first(unnamed.union(unnamed)).count() == unnamed.count()


def test_repeated_id_over_different_groups(spark, edge):
    rng = random.Random(11)
    a, b, c = (" ".join(rng.choices("qwertyuiopasdfgh", k=60)) for _ in range(3))
    docs = spark.createDataFrame([(5, a), (6, a), (5, b), (8, b), (3, c), (5, c), (5, a)], "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, simhash.keep_first(docs).collect())) == sorted([(5, a), (5, b), (3, c)])
