import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lendgov.llm import packing
from lendgov.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def check(docs, got, length=1024):
    """Pieces, ids and places against the tokenizer itself; ids are unique in ``docs``."""
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = got.toPandas().sort_values(["doc_id", "piece"])
    assert set(rows.doc_id) == set(text)
    for doc_id, g in rows.groupby("doc_id"):
        ids = np.array(exact.encode(text[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert g.piece.tolist() == list(range(len(g))) and g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids)
        assert (g.length.iloc[1:] == length).all() and (len(g) == 1 or len(ids) > length) and g.length.max() <= length
        assert g.ids_crc32.tolist() == [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(g.start, g.length)]
    placed = rows.sort_values(["sequence_id", "offset"])
    ends = placed.groupby("sequence_id").length.cumsum()
    assert (ends - placed.length == placed.offset).all() and ends.max() <= length
    return rows


def test_query(spark):
    rows = check(spark.read.parquet(f"{SF}/documents.parquet"), QUERIES["op9_best_fit_packing"](spark, SF))
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) * 1.02 + 1


def brute_least(lengths, room):
    """Fewest sequences, by trying all ways (few pieces)."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= room and bins[j] not in bins[:j]:
                go(i + 1, bins[:j] + [bins[j] + lengths[i]] + bins[j + 1:])
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=9))
def test_plan_uses_each_piece_once_and_few_sequences(lengths):
    counts = Counter(lengths)
    plan = packing.make_plan(dict(counts), 16)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 16 and times > 0
        for x in pattern:
            used[x] += times
    assert used == counts
    assert sum(n for _, n in plan) <= brute_least(sorted(lengths, reverse=True), 16) + 1
    places = packing.Assignment.of(plan)
    taken = set()
    for x, n in counts.items():
        s, o = places.place(np.full(n, x), np.arange(n))
        for a, b in zip(s.tolist(), o.tolist()):
            span = {(a, b + i) for i in range(x)}
            assert not span & taken
            taken |= span


def test_exact_fills_by_one_two_and_three():
    for lengths in ([10, 6], [9, 4, 3], [7, 4, 3, 2], [4, 4, 4, 4], [8, 8]):
        counts = dict(Counter(lengths))
        assert [sorted(p, reverse=True) for p, _ in packing.exact_fills(counts, 16)] == [sorted(lengths, reverse=True)]
        assert not any(counts.values())


@pytest.mark.parametrize("text", ["", "a <|endoftext|> b", "<|endoftext|>", "it's  we'll\n\n x\t y  ", "日本語 текст ½ ²", " a\x00", "a" * 5000, " " * 3000, "\U0001f600" * 50])
def test_ids_equal_the_tokenizers_file(text):
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert packing.load_encoder()(text) == exact.encode(text, add_special_tokens=False).ids


def test_edges(edge, empty, nulls):
    got = packing.pack(edge).toPandas()
    ones = got[got.doc_id.isin([1, 2])]
    assert (ones.length == 1).all() and len(ones) == 2
    assert len(got[got.doc_id == 7]) == 3 and got[got.doc_id == 7].ids.map(bytes).nunique() == 1
    assert got.doc_id.isna().sum() == 2
    assert [np.frombuffer(x, "<u4").tolist() for x in ones.ids] == [[2], [2]]
    assert packing.pack(empty).count() == 0
    assert packing.pack(nulls).toPandas().sequence_id.nunique() == 1
    placed = got.sort_values(["sequence_id", "offset"])
    ends = placed.groupby("sequence_id").length.cumsum()
    assert (ends - placed.length == placed.offset).all() and ends.max() <= 1024
