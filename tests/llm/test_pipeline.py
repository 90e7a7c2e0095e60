import re

import corpus_pipeline
import numpy as np

from lendgov.llm import pii
from lendgov.llm.simhash import fingerprint

from .test_mixing import n_words, slow_targets
from .test_packing import check as check_packing
from .test_simhash import slow_components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_dedup", "pii", "mixing", "packing"]
    was = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        now = docs.toPandas()
        if name == "language_id":
            assert set(now.doc_id) <= set(was.doc_id) and len(now) >= 0.97 * len(was)
            assert now.text.map(lambda t: bool(re.search(r"[^\W\d_]", t))).all()
        elif name == "simhash_dedup":
            root = slow_components(was.doc_id.tolist(), [fingerprint(t) for t in was.text])
            assert sorted(now.doc_id) == sorted(set(root)) and len(now) < len(was)
        elif name == "pii":
            want = {i: pii.redact(t, pii.find_spans(t)) for i, t in zip(was.doc_id, was.text)}
            assert dict(zip(now.doc_id, now.text)) == want and (now.n_chars == now.text.map(len)).all()
            assert not now.text.str.contains("@").any() and now.text.str.contains(r"\[EMAIL\]").any()
        else:
            sizes = was.assign(n=was.text.map(n_words)).groupby("source").n.sum().to_dict()
            want = slow_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))})
            got = now.assign(n=now.text.map(n_words)).groupby("source").n.sum()
            assert all(abs(got.get(s, 0) - w) <= 0.5 + 1e-9 for s, w in want.items())
            assert now.groupby("doc_id").size().max() <= 3
        was = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == set(was.doc_id)
    placed = packed.sort_values(["sequence_id", "offset"])
    ends = placed.groupby("sequence_id").length.cumsum()
    assert (ends - placed.length == placed.offset).all() and ends.max() <= 1024
    once = docs.dropDuplicates(["doc_id"]).where("doc_id in (%s)" % ",".join(map(str, was.doc_id[~was.doc_id.duplicated(keep=False)])))
    from lendgov.llm import packing
    check_packing(once, packing.digest(packing.pack(once)))


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert got.columns.tolist() == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    again = corpus_pipeline.run(spark, SF).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert np.array_equal(got[cols].sort_values(cols).to_numpy(), again[cols].sort_values(cols).to_numpy())


def test_edges(spark, edge, empty, nulls):
    for docs in (edge, empty, nulls):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= 3 * docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
