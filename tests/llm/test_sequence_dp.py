import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lendgov.llm import packing, sequence_dp
from lendgov.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def ids_of(text, end=0, exact=Tokenizer.from_file(P.path("byte_bpe_50k.json"))):
    return np.array(exact.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def filled(rows, length=1024):
    """Lengths of the sequences; their pieces lie in them without gaps."""
    out = {}
    for s, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
        out[s] = at
    return out


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_sequence_packing"](spark, SF).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.start):
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, own in by_doc.items():
        ids = ids_of(texts[doc_id])
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in own)
    sizes = filled(rows).values()
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes) <= 0.015 * sum(sizes)
    assert len(sizes) <= 1.2 * sum(sizes) / 1024


def least_cost(positions, penalties, length, costs):
    """By trying every set of cuts."""
    inner = range(1, len(positions) - 1)
    best = None
    for k in range(len(positions) - 1):
        for chosen in itertools.combinations(inner, k):
            ends = [0, *chosen, len(positions) - 1]
            spans = [positions[b] - positions[a] for a, b in zip(ends, ends[1:])]
            if max(spans) <= length:
                c = sum((0 if s & (s - 1) == 0 else length - s) + costs.window for s in spans) + sum(penalties[j] for j in ends[1:])
                best = c if best is None else min(best, c)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 32), st.sampled_from([0, 2, 6])), min_size=1, max_size=11), st.integers(0, 11))
def test_the_cost_is_the_least_of_all_ways_also_when_settled_on_the_way(steps, settle_at):
    costs = sequence_dp.Costs(3, 2, 6)
    positions = [0, *np.cumsum([n for n, _ in steps]).tolist()]
    penalties = [0, *(p for _, p in steps)]
    cutter, cuts, paid = sequence_dp.Cutter(32, costs), [0], 0
    for i, (p, pen) in enumerate(zip(positions[1:], penalties[1:])):
        cutter.add([p], [pen])
        if i == settle_at:
            cuts += cutter.settle(False)[1:]
    cuts += cutter.settle(True)[1:]
    assert cuts[0] == 0 and cuts[-1] == positions[-1]
    spans = [b - a for a, b in zip(cuts, cuts[1:])]
    paid = sum((0 if s & (s - 1) == 0 else 32 - s) + costs.window for s in spans) + sum(penalties[positions.index(c)] for c in cuts[1:])
    assert max(spans) <= 32 and paid == least_cost(positions, penalties, 32, costs)


def test_settling_often_gives_the_same_cuts(monkeypatch):
    rng = random.Random(3)
    docs = [(i, np.arange(rng.randrange(1, 3000), dtype="<u4"), None) for i in range(120)]
    docs = [(i, ids, np.array(sorted(rng.sample(range(len(ids) + 1), len(ids) // 20)), np.int64)) for i, ids, _ in docs]

    def run():
        s = sequence_dp.Stream(1024, sequence_dp.Costs(), 0)
        out = [r for d in docs for r in s.add(*d)]
        return out + list(s.finish())

    whole = run()
    monkeypatch.setattr(sequence_dp, "HORIZON", 3000)
    assert run() == whole


def sentences(text):
    encoder = packing.load_encoder()
    known = sequence_dp.vocabulary(encoder)
    ids = np.array(encoder(text), np.int64)
    ends = np.cumsum(known.width[ids])
    assert not len(ids) or ends[-1] == len(text.encode())
    at = [0, *ends[known.sentence_ends(text, ids) - 1].tolist()]
    return [text.encode()[a:b].decode() for a, b in zip(at, at[1:])]


def test_cuts_fall_on_sentence_ends_of_any_script():
    assert sentences('One. "Two!" (Three?) no.stop\nनमस्ते। फिर 日本。語 سلام؟ نعم <|endoftext|> End.') == [
        "One.", ' "Two!"', " (Three?)", " no.stop\n", "नमस्ते।", " फिर 日本。", "語 سلام؟"]
    assert sentences("Ein Mädchen à la carte, ça va ¤ ¡ ¢ ä ё। x") == ["Ein Mädchen à la carte, ça va ¤ ¡ ¢ ä ё।"]  # bytes of a mark alone are none
    assert sentences("") == [] and sentences("no end") == []


@pytest.mark.parametrize("text", ["x" * 100_000, "word " * 40_000, "", None, "<|endoftext|>" * 3000])
def test_long_texts_without_sentences(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "Short. One.")], "doc_id long, text string").coalesce(1)
    rows = sequence_dp.pack(docs).collect()
    got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(rows, key=lambda r: r.start) if r.doc_id == 1])
    assert got.tolist() == ids_of(text).tolist()
    sizes = filled(rows).values()
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes) <= 1024


def test_edges(spark, edge, empty, nulls):
    rows = sequence_dp.pack(edge).collect()
    filled(rows)
    assert sorted(r.doc_id for r in rows if r.start == 0 and r.doc_id is not None) == sorted(r.doc_id for r in edge.collect() if r.doc_id is not None)
    assert sum(1 for r in rows if r.doc_id is None and r.start == 0) == 2
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows if r.doc_id in (1, 2)] == [[0], [0]]
    assert sequence_dp.pack(empty).count() == 0
    assert len(sequence_dp.pack(nulls).collect()) == 3
    p = sequence_dp.padding(sequence_dp.pack(edge)).first()
    assert p.tokens == sum(r.length for r in rows) and p.padding <= 8 * 1024
