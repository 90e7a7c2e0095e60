import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lendgov.llm import manifest
from lendgov.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LOWER = {ord(a): ord(a.lower()) for a in manifest.UPPER}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row, each tree built anew for each leaf."""
    groups = defaultdict(list)
    for r in rows:
        text = r[4]
        touched = zlib.crc32(str(r[0]).encode()) % 3 == 0 if r[0] is not None else False
        changed = text.translate(LOWER) if touched and text is not None else text
        groups[r[2]].append((r[0], leaf(*r), leaf(*r[:4], changed)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    own = {g: levels([x[1] for x in groups[g]]) for g in names}
    upper = levels([own[g][-1][0] for g in names]) if names else []
    out = []
    for i, g in enumerate(names):
        for at, (doc_id, lf, changed) in enumerate(groups[g]):
            proof, place, digest = [], at, changed
            for tree, start in ((own[g], at), (upper, i)):
                place = start
                for nodes in tree[:-1]:
                    run = place - place % 8
                    kids = nodes[run:run + 8]
                    proof += kids[:place - run] + kids[place - run + 1:]
                    kids[place - run] = digest
                    digest, place = h(*kids), place // 8
            root = upper[-1][0]
            out.append((doc_id, lf, own[g][-1][0], root, h(*proof), digest, digest == root))
    return out


def rows_of(docs):
    return [tuple(r) for r in docs.select(*manifest.FIELDS).collect()]


def as_rows(df):
    return Counter(tuple(r) for r in manifest.digest(df).collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.data())
def test_midstates_fold_like_a_new_tree(n, data):
    nodes = [h(str(i)) for i in range(n)]
    tree = manifest.block_tree(nodes, 0, 4)
    want = levels(nodes)
    assert [[x.decode() for x in ns] for ns in tree.nodes] == want
    place = data.draw(st.integers(0, n - 1))
    changed = [*nodes]
    changed[place] = h("other")
    assert tree.fold(place, changed[place].encode()).decode() == levels(changed)[-1][0]
    assert len(tree.states[0]) == n if n > 1 else not tree.states


def test_query_equals_plain_trees(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter(tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, SF).collect())
    assert got == Counter(plain(rows_of(docs)))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("deep", [1, 2, 3])
def test_edges_and_any_block_size(edge, deep):
    assert as_rows(manifest.of_documents(edge, deep).folded("changed")) == Counter(plain(rows_of(edge)))


def test_hot_group_and_many_groups_over_several_rounds(spark):
    # a language with half of the rows, one repeated row that is a third of them, and 90 small languages
    docs = spark.sql("""select if(id % 3 = 0, 7, id) as doc_id, 's' as source, if(id % 2 = 0 or id % 3 = 0, 'en', concat('l', id % 90)) as lang,
                        if(id % 3 = 0, 1L, id) as n_chars, if(id % 3 = 0, 'Same Text', concat('Text ', id)) as text from range(0, 3000, 1, 6)""")
    m = manifest.of_documents(docs, 1)
    assert len(m.rounds) == 4 and len(m.upper) == 2
    assert as_rows(m.folded("changed")) == Counter(plain(rows_of(docs)))


def test_empty_and_null_rows(empty, nulls):
    m = manifest.of_documents(empty)
    assert m.root is None and m.folded("changed").count() == 0
    got = as_rows(manifest.of_documents(nulls).folded("changed"))
    assert got == Counter(plain([(None,) * 5] * 3)) and sum(got.values()) == 3


def test_one_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(5, "a", "en", 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    (r,) = manifest.digest(manifest.of_documents(docs).folded("changed")).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == hashlib.sha256(b"").hexdigest()
