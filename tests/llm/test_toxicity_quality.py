import math
import zlib
from collections import Counter

import numpy as np

from lendgov.llm import quality, toxicity
from lendgov.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    got = QUERIES["op3_toxicity"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted).all()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    # some of these labels are flipped at random, so neither share can be 1 or 0
    assert held.predicted[held.toxic == 1].mean() > 0.85 and held.predicted[held.toxic == 0].mean() < 0.02


def test_toxicity_does_not_read_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out_column(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score_documents(docs, x).toPandas().sort_values("doc_id").reset_index(drop=True) for x in (labels, turned))
    assert a.equals(b)


def test_label_model_finds_accuracies_and_doubts_labels():
    rng = np.random.default_rng(0)
    n = 6000
    true = rng.random(n) < 0.2
    hits = [0.9, 0.8, 0.7, 0.6, 0.5]
    votes = np.column_stack([rng.random(n) < np.where(true, h, 0.01) for h in hits] + [rng.random(n) < 0.3]).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # a voter that repeats the first
    given = true ^ (rng.random(n) < 0.05)
    q, found = toxicity.label_model(votes, given.astype(int), np.ones(n), n_signs=5)
    missed = true & ~given & (votes[:, :5].sum(1) >= 2)  # the label says no, several voters say yes
    assert missed.sum() > 30 and (q[missed] >= 0.5).mean() > 0.95
    assert ((q >= 0.5) != true).mean() < (given != true).mean()
    assert (np.diff(found["rate"][1][:5]) < 0).all() and (found["rate"][0][:5] < 0.02).all()
    assert found["correlation"][0, 6] > 0.9 and found["weight"][6] < found["weight"][4] < found["weight"][5]


def test_term_keys_are_those_of_plain_words():
    found = {int(k) for _, ks in toxicity._terms([toxicity._bytes("Idiots, and IDIOT!")]) for k in ks}
    assert set(toxicity.word_keys(["idiot"]).tolist()) <= found and not set(toxicity.word_keys(["idio"]).tolist()) & found
    doc, term, n = toxicity.Lexicon(toxicity.word_keys(["scum", "moron"])).counts([b"scum scum", b"", b"a moron scum"])
    assert sorted(zip(doc.tolist(), n.tolist())) == [(0, 2), (2, 1), (2, 1)]


def test_term_keys_read_whole_words():
    keys = lambda t: {int(k) for _, ks in toxicity._terms([toxicity._bytes(t)]) for k in ks}
    assert keys("Vollidiot") & keys("idiot") and keys("Riesendepp") & keys("depp")
    assert keys("你们大家今天真是一群傻瓜") != keys("你们大家今天真是一群好人")
    same_start = ["donaudampfschiff", "donaudampfschaff", "donaudam", "donaudampfschifffahrt"]
    assert len(toxicity.word_keys(same_start)) == 4
    long = [bytes([97 + i % 7]) * i for i in range(1, 300)]  # in one text or in many, the keys are the same
    apart = {int(k) for t in long for _, ks in toxicity._terms([t]) for k in ks}
    assert {int(k) for _, ks in toxicity._terms([b" ".join(long)]) for k in ks} == apart


def test_toxicity_in_compounds_and_unspaced_text(spark):
    def rows(at, insult, plain, build):
        return [(at + i, build(i, insult if i % 2 else plain), i % 2) for i in range(400)]

    heads, chars = ("Häuser", "Garten", "Küchen", "Riesen", "Meister", "Schulen", "Wetter"), "天地人山水火木金土日月星风雨"
    german = rows(0, "depp", "werk", lambda i, w: f"Der Nachbar war ein {heads[i // 2 % 7]}{w} und kam {heads[i // 3 % 7]}spät")
    chinese = rows(1000, "傻瓜", "朋友", lambda i, w: "你们大家" + "".join(chars[(i // 2 * k + k) % 14] for k in (1, 2, 3, 5)) + w + chars[i // 2 % 14] + "啊")
    docs = spark.createDataFrame([r[:2] for r in german + chinese], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in german + chinese], "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert len(got) > 100 and (got.predicted == got.toxic).all()


def test_toxicity_edges(spark, edge, empty, nulls):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 200)] + [(7, None), (None, 1), (8, 1), (8, 0)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(edge, labels).toPandas()
    assert len(got) == edge.count() and got.score.between(0, 1).all()
    blank = got[got.doc_id.isin([1, 2, 3])].score
    assert blank.nunique() == 1
    none = labels.where("false")
    assert toxicity.score_documents(edge, none).count() == edge.count()
    insult = spark.createDataFrame([(1, "you idiot"), (2, "a fine day")], "doc_id bigint, text string")
    assert dict(toxicity.score_documents(insult, none).select("doc_id", "predicted").collect()) == {1: 1, 2: 0}
    assert toxicity.score_documents(empty, labels).count() == 0 and toxicity.score_documents(nulls, labels).count() == 3


def test_quality_agrees_with_labels_it_never_reads(spark):
    got = QUERIES["op4_quality"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.score.between(0, 1).all()
    both = got.merge(labels, on="doc_id")
    assert both.predicted[both.quality == 0].mean() < 0.1 and both.predicted[both.quality == 1].mean() > 0.97


def test_expectation_maximisation_finds_the_classes():
    rng = np.random.default_rng(1)
    n, k = 4000, len(quality.LABELLERS)
    good = rng.random(n) < 0.8
    # a bad document is of one kind, which one or two labellers see; they hardly ever object to a good one
    kind = rng.integers(0, k, n)
    seen = [(kind == j) & (rng.random(n) < 0.95) | (kind == (j + 1) % k) & (rng.random(n) < 0.3) for j in range(k)]
    bad_votes = np.column_stack([np.where(good, rng.random(n) < 0.001, s) for s in seen]).astype(bool)
    v = np.column_stack([bad_votes, ~bad_votes.any(1)]).astype(int)
    pattern, counts = np.unique(quality._pattern(v), return_counts=True)
    assert (quality._of_pattern(pattern) == np.array([[p >> j & 1 for j in range(k + 1)] for p in pattern])).all()
    model = quality.estimate(pattern, counts.astype(float))
    q = model.posterior(v)
    assert ((q >= 0.5) == good).mean() > 0.97 and abs(model.prior - 0.8) < 0.1


def test_quality_edges(spark, edge, empty, nulls):
    got = quality.score_documents(edge).toPandas()
    assert len(got) == edge.count() and got.score.between(0, 1).all()
    assert got[got.doc_id == 7].score.nunique() == 1
    assert quality.score_documents(empty).count() == 0 and quality.score_documents(nulls).count() == 3


def captured_fit(monkeypatch, module):
    """What the classifier is fitted on: number of rows and their weights."""
    seen, fit = {}, module.C.fit_logistic

    def spy(rows, cols, vals, n_rows, n_cols, target, weight, **how):
        seen.update(rows=n_rows, weight=weight)
        return fit(rows, cols, vals, n_rows, n_cols, target, weight, **how)

    monkeypatch.setattr(module.C, "fit_logistic", spy)
    return seen


def test_copies_of_a_sampled_row_are_one_row_of_the_sample(spark, monkeypatch):
    # 30,000 copies of one row, and under one id as many different texts
    docs = spark.range(0, 62_000, 1, 8).selectExpr(
        "case when id < 30000 then 1 when id < 60000 then 2 else id end as doc_id",
        """case when id < 30000 then 'You are such an idiot and scum, all of you here.' when id < 60000 then concat('A calm day number ', id, ' in the green valley.')
           when id % 2 = 0 then concat('You moron and idiot, number ', id, ' of the worthless scum.') else concat('The valley was calm on day ', id, '.') end as text""")
    labels = spark.createDataFrame([(1, 1), (2, 0)] + [(i, 1 - i % 2) for i in range(60_000, 62_000)], "doc_id bigint, toxic int")
    seen = captured_fit(monkeypatch, toxicity)
    model = toxicity.learn(docs, labels, sample_docs=500)
    assert seen["rows"] <= 1000
    assert model.score(["You idiot and scum"])[0] > model.score(["The valley was calm"])[0]
    assert seen["weight"].max() >= 30_000 or not {1, 2} & {r.labelled_id for r in toxicity._sample(labels, 500)[0].collect()}
    whole = toxicity.learn(docs, labels)
    assert seen["rows"] == 2002 and seen["weight"].max() == 30_000
    assert whole.score(["You are such an idiot and scum, all of you here."])[0] > 0.5 > whole.score(["The valley was calm"])[0]

    seen = captured_fit(monkeypatch, quality)
    mixed = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("### BUY!!! NOW!!! $$$ " * 5)).when(F.col("doc_id") % 2 == 0, F.lit("| * | # |")).otherwise(F.repeat("text", 4)))
    _, fitted = quality.learn(mixed, sample_docs=400)
    assert 0 < seen["rows"] <= 800


def plain_term_keys(text):
    """Windows of 4 to 7 bytes from word beginnings, inside words of more than 8 bytes from every character, and whole words."""
    m64, out = (1 << 64) - 1, []
    for word in toxicity._bytes(text).split(b" "):
        for at in range(len(word) if len(word) > 8 else min(len(word), 1)):
            if word[at] & 0xC0 != 0x80:
                out += [(int.from_bytes(word[at:at + n], "little") | n << 56) * int(toxicity._MIX) & m64 for n in (4, 5, 6, 7) if at + n <= len(word)]
        if word:
            h, power = 0, int(toxicity._POWER)
            for i, c in enumerate(word):
                h = h + c * pow(power, i + 1, 1 << 64) & m64
            h = (h ^ h >> 32) * int(toxicity._MIX) & m64
            out.append(h ^ h >> 29)
    return out


def test_toxicity_scores_are_the_plain_sums(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels.select("doc_id", "toxic").where(~toxicity.held_out_column()))
    weight = dict(zip(model.lexicon.keys.tolist(), model.weight.tolist()))
    got = {r.doc_id: r.score for r in QUERIES["op3_toxicity"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        n = Counter(k for k in plain_term_keys(r.text or "") if k in weight)
        z = sum(weight[k] * math.log1p(c) for k, c in n.items()) + model.bias
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(min(z, 35.0), -35.0)))) < 1e-9
    assert len(got) == len(rows)


def test_quality_scores_are_the_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, model = quality.learn(docs.select("doc_id", "text"))
    got = {r.doc_id: r.score for r in QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").collect()}
    high = [x[2] for x in quality.LABELLERS]
    for r in docs.select("doc_id", "text").collect():
        kinds = [int(quality._CLASS[c]) for c in (r.text or "").encode().replace(b"\0", b" ")]
        grams = [sum(k << 7 * i for i, k in enumerate(kinds[j:j + 4])) & 0xFFFFFFFF for j in range(len(kinds) - 3)]
        at = [(g * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - quality.HASH_BITS for g in grams]
        z = sum(model.weight[a] for a in at) / max(len(at), 1) * quality._SHAPE_SCALE + model.bias
        for i, m in enumerate(quality.measures(r.text)):
            bucket = sum(m / high[i] > e for e in quality._EDGES.tolist())
            z += model.weight[(1 << quality.HASH_BITS) + i * quality.BUCKETS + bucket]
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(min(z, 35.0), -35.0)))) < 1e-6
