import re

import pytest
from pyspark.sql import functions as F

from lendgov.llm import mixing
from lendgov.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def slow_targets(sizes, weights, most=3):
    total, target, capped = sum(sizes.values()), {}, {}
    while True:
        rest, open_ = total - sum(capped.values()), [s for s in sizes if s not in capped]
        if not open_:
            return capped
        target = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return capped | target
        capped |= {s: most * sizes[s] for s in over}


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(docs, got):
    """Against plain definitions; docs has no repeated rows."""
    rows = docs.select("doc_id", "text", "source").toPandas()
    both = got.toPandas().merge(rows, on="doc_id")
    assert len(both) == len(rows)
    assert (both["size"] == both.text.map(n_words)).all()
    sizes = both.groupby("source")["size"].sum().to_dict()
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    want = slow_targets(sizes, weights)
    for s, g in both.groupby("source"):
        assert (g.source_size == sizes[s]).all() and g.target.iloc[0] == pytest.approx(want[s])
        assert abs(g.taken.sum() - want[s]) <= 0.5 + 1e-9
        assert (g.taken <= 3 * g["size"]).all()
        full, whole = divmod(round(want[s]), sizes[s]) if sizes[s] else (0, 0)
        part = g[(g.taken != full * g["size"]) & (g.taken != (full + 1) * g["size"])]
        assert len(part) <= 1  # only the document on the cut


def test_query(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"), QUERIES["op5_mix_sources"](spark, SF))


def test_reruns_and_partitions_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (mixing.taken(d).toPandas().sort_values("doc_id").reset_index(drop=True) for d in (docs, docs.repartition(7)))
    assert a.equals(b)


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 2 + ["c"] * 3 + ["d"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(docs, mixing.taken(docs))
    got = mixing.taken(docs).toPandas()
    assert (got.taken[got.doc_id.between(300, 304)] == 3 * got["size"][got.doc_id.between(300, 304)]).all()


def test_given_weights(spark):
    docs = spark.createDataFrame([(i, "a b c d", "ab"[i % 2]) for i in range(100)], "doc_id bigint, text string, source string")
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    got = mixing.taken(docs, weights=w).toPandas()
    assert got[got.doc_id % 2 == 0].taken.sum() == 300 and got[got.doc_id % 2 == 1].taken.sum() == 100


def test_repeated_documents_carry_what_was_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.repeated(docs)
    assert mix.columns == docs.columns and mix.dtypes == docs.dtypes
    have = mix.select("doc_id", "text", "n_chars").toPandas()
    assert (have.n_chars == have.text.map(len)).all()
    taken = mixing.taken(docs).toPandas().set_index("doc_id").taken
    got = have.assign(n=have.text.map(n_words)).groupby("doc_id").n.sum()
    assert got.to_dict() == taken[taken > 0].to_dict()


def test_first_words_keeps_the_text(spark):
    text = "  a b\t\tc \n d  "
    rows = spark.createDataFrame([(text, n) for n in range(1, 6)], "t string, n bigint").select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()
    assert [r.x for r in rows] == ["  a", "  a b", "  a b\t\tc", "  a b\t\tc \n d", text]


def test_plan_has_no_python(spark, capsys):
    QUERIES["op5_mix_sources"](spark, SF).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_edges(edge, empty, nulls):
    got = mixing.taken(edge).toPandas()
    assert len(got) == edge.count()
    assert (got[got.doc_id.isin([1, 2, 3])].taken == 0).all()
    same = got[got.doc_id == 7]  # repeated rows share alike, to a word
    assert len(same) == 3 and same.taken.max() - same.taken.min() <= 1
    assert (got.taken <= 3 * got["size"]).all()
    by_target = got.groupby("target").agg(t=("taken", "sum"), d=("target", "first"))
    assert ((by_target.t - by_target.d).abs() <= 0.5 + 1e-9).all()
    assert mixing.taken(empty).count() == 0
    assert mixing.taken(nulls).toPandas()[["size", "taken"]].eq(0).all().all()
    assert mixing.repeated(edge).columns == edge.columns and mixing.repeated(empty).count() == 0 and mixing.repeated(nulls).count() == 0


def test_repeated_rows_reach_the_window_as_one(spark, edge, monkeypatch):
    plans, written = {}, mixing.C.written
    monkeypatch.setattr(mixing.C, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), written(df, name))[1])
    docs = edge.where("doc_id > 99").unionByName(spark.range(500).crossJoin(edge.where("doc_id = 100")).select(*edge.columns))
    got = mixing.taken(docs).toPandas()
    for _, g in got.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5 + 1e-9
    lines = plans["mix-cuts"].splitlines()
    at = next(i for i, x in enumerate(lines) if "Window" in x and "cut_bucket" in x)
    before_join = lines[at + 1:next(i for i, x in enumerate(lines) if i > at and "Join" in x)]
    assert any("Aggregate [" in x and "key#" in x.split("]")[0] for x in before_join)


def test_copies_on_the_cut_fill_the_budget(spark):
    # 30,000 equal rows are one source, most of the other has one word each
    docs = spark.range(0, 40_000, 1, 7).selectExpr("if(id < 30000, 1L, id) as doc_id", "if(id < 30000, 'one', 'two words') as text", "if(id < 30000, 'a', 'b') as source")
    got = mixing.taken(docs).groupBy("target").agg(F.sum("taken").alias("taken"), F.max("taken").alias("most"), F.min("taken").alias("least"), F.count("*").alias("n")).toPandas()
    assert len(got) == 2 and ((got.taken - got.target).abs() <= 0.5).all() and set(got.n) == {30_000, 10_000}
    copies = got[got.n == 30_000].iloc[0]
    assert copies.target < 30_000 and copies.most == 1 and copies.least == 0
    assert mixing.repeated(docs).groupBy("source").count().orderBy("source").first()["count"] == copies.taken
