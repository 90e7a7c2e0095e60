import math

import numpy as np
import pandas as pd

from lendgov.functions.prefix import roc_auc, running_sums
from lendgov.operators import prep as PR


def _auc(spark, labels, scores):
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(labels, scores)], "label int, score double")
    return roc_auc(df).collect()[0].auc


def test_auc_edges(spark):
    assert _auc(spark, [0, 1, 0, 1], [0.5, 0.5, 0.5, 0.5]) == 0.5
    assert _auc(spark, [1, 1, 1], [0.1, 0.2, 0.3]) == 0.0
    assert _auc(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]) == 1.0


def test_auc_matches_pairwise(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400), 2)  # ties
    pos, neg = s[y == 1], s[y == 0]
    ref = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(_auc(spark, y, s) - ref) < 1e-12


def test_running_sums(spark):
    df = spark.range(0, 5000).selectExpr("id * 7919 % 100003 AS k", "id % 5 AS v")
    got = running_sums(df, "k", ["v"]).toPandas().sort_values("k")
    assert (got.v.cumsum().values == got.v_cum.values).all()


def test_mode_tie_smallest_and_all_null(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)],
                               "c string, d string")
    m = {r.column_name: r.mode_value for r in PR.mode_table(df, ["c", "d"]).collect()}
    assert m == {"c": "a"}
    out = PR.impute_mode(df, ["c", "d"]).collect()
    assert [r.c for r in out].count("a") == 3
    assert all(r.d is None for r in out)


def test_one_hot_unseen_zero(spark):
    train = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, c string")
    out = PR.one_hot(train, ["c"], keys=["id"], domains={"c": ["x", "y", "z"]}).orderBy("id").collect()
    assert [tuple(r)[1:] for r in out] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def test_impute_median_and_standardize(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 10.0)], "id long, x double")
    imp = {r.id: r.x for r in PR.impute_median(df, ["x"], keys=["id"]).collect()}
    assert imp[2] == 3.0
    std = PR.standardize(spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, x double"), ["x"], keys=["id"])
    assert [r.x for r in std.collect()] == [0.0, 0.0]  # zero std counts as 1


def test_stratified_split_counts(spark):
    n = 10007
    df = spark.range(0, n).selectExpr("id AS application_id", "CAST(id % 3 = 0 AS INT) AS y")
    out = PR.stratified_split(df, "application_id", "y", 0.2, bucket_bits=8).toPandas()
    assert len(out) == n
    for cls, grp in out.groupby("y"):
        assert grp.is_test.sum() == math.ceil(0.2 * len(grp))
    # same rows as a per-class window ranking
    pdf = df.toPandas()
    pdf["h"] = (pdf.application_id * PR.SPLIT_MULT) % PR.SPLIT_MOD
    pdf = pdf.sort_values(["y", "h", "application_id"])
    pdf["r"] = pdf.groupby("y").cumcount() + 1
    pdf["k"] = pdf.groupby("y").y.transform(lambda s: math.ceil(0.2 * len(s)))
    want = set(pdf[pdf.r <= pdf.k].application_id)
    assert set(out[out.is_test].application_id) == want


def test_training_smoke(spark):
    from pyspark.sql import functions as F
    from lendgov.operators import training as TR
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=400), "b": rng.normal(size=400),
                        "c": rng.choice(["u", "v"], 400)})
    pdf["label"] = (pdf.a + 0.5 * pdf.b + rng.normal(scale=0.3, size=400) > 0).astype(int)
    df = spark.createDataFrame(pdf)
    model = TR.fit(df, ["a", "b"], ["c"], TR.logistic(400))
    pred = TR.positive_probability(model, df, ["label"])
    m = TR.metrics(pred, "label", "p").collect()[0]
    assert 0.8 < m.auc <= 1.0 and 0.0 <= m.accuracy <= 1.0
    best = TR.select_best(spark.createDataFrame([(0, "l", 0.9, 0.5), (1, "f", 0.9, 0.5)],
                                                "model_order int, model string, auc double, f1 double"))
    assert best.collect()[0].model == "l"
    assert F is not None


def test_distributed_lag_matches_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from lendgov.functions.prefix import distributed_lag
    # one hot key spanning every range plus many small keys
    df = spark.range(0, 6000).selectExpr("CASE WHEN id < 4000 THEN 0 ELSE id % 97 + 1 END AS k",
                                         "id AS t", "CAST((id * 7) % 5 AS INT) AS v")
    got = distributed_lag(df, ["k"], ["t"], "v", -1, num_ranges=7).toPandas().sort_values(["k", "t"])
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("*", F.lag("v", 1, -1).over(w).alias("prev")).toPandas().sort_values(["k", "t"])
    assert (got.prev.values == want.prev.values).all()


def test_credit_g_training(spark):
    from lendgov.operators import training as TR
    rng = np.random.default_rng(11)
    n = 300
    amount = rng.integers(500, 10000, n)
    status = rng.choice(["<0", "0<=X<200", "no checking"], n)
    cls = np.where((amount < 5000) | (status == "no checking"), "good", "bad")
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "credit_amount": amount,
                                             "checking_status": status, "class": cls}))
    model, pred = TR.train_credit_g(df, "id")
    m = TR.metrics(pred, "label", "p").collect()[0]
    assert pred.count() == sum(math.ceil(0.2 * c) for c in pd.Series(cls).value_counts())
    assert 0.0 <= m.auc <= 1.0 and m.n == pred.count()


def test_probabilities_sum_to_one(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    from lendgov.operators import training as TR
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "c": rng.choice(["u", "v", None], 200)})
    pdf["label"] = (pdf.a > 0).astype(int)
    df = spark.createDataFrame(pdf)
    df = TR.filled(df, TR.fill_values(df, ["a"], ["c"]), ["c"])
    for est in (TR.logistic(200), TR.forest(num_trees=5, max_depth=3)):
        out = TR.fit(df, ["a"], ["c"], est).transform(df)
        s = out.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda x, y: x + y).alias("s"))
        assert all(abs(r.s - 1.0) < 1e-9 for r in s.collect())


def test_split_hash_of_large_ids(spark):
    from lendgov.operators import prep as PR
    ids = [0, 1, 7, 3_470_000_000, 4_294_967_295, 10**12, 10**12 + 1, 2**62, -5]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(PR.split_hash("id")).collect()]
    assert got == [(i % PR.SPLIT_MOD) * PR.SPLIT_MULT % PR.SPLIT_MOD for i in ids]
    out = PR.stratified_split(spark.range(10**12, 10**12 + 1000).selectExpr("id", "id % 2 AS y"), "id", "y", 0.2)
    assert out.where("is_test").groupBy("y").count().collect()[0]["count"] == 100


def test_scaled_columns_have_population_deviation(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from lendgov.operators import training as TR
    df = spark.createDataFrame([(1.0, "u", 0), (2.0, "v", 1), (4.0, "u", 1)], "a double, c string, label int")
    model = TR.fit(df, ["a"], ["c"], TR.logistic(3))
    got = [r[0][0] for r in model.transform(df).orderBy("a").select(vector_to_array("num_std")).collect()]
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose(got, (x - x.mean()) / x.std())


def test_logit_parts_add_up_to_the_models_probability(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from lendgov.operators import training as TR
    rng = np.random.default_rng(5)
    rows = [(int(i), float(a), float(b), "xyz"[i % 3], int(a + b + rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, label int")
    model = TR.fit(df, ["a", "b"], ["c"], TR.logistic(200))
    parts, bias = TR.logit_parts(model, ["a", "b"], ["c"])
    total = sum(parts[1:], parts[0]) + F.lit(bias)
    p = TR.positive_probability(model, df.withColumn("own", 1 / (1 + F.exp(-total))), ["id", "own"]).collect()
    assert all(abs(r.own - r.p) < 1e-9 for r in p)


def test_modes_with_many_distinct_values(spark):
    from lendgov.operators import prep as PR
    df = spark.range(5000).selectExpr("CASE WHEN id < 3 THEN 'b' WHEN id < 6 THEN 'a' ELSE CAST(id AS STRING) END AS c")
    assert [tuple(r) for r in PR.mode_table(df, ["c"]).collect()] == [("c", "a", 3)]


def test_a_forest_is_fitted_by_several_tasks_from_one_file(spark, monkeypatch):
    from lendgov.operators import prep as PR
    from lendgov.operators import training as TR

    monkeypatch.setattr(PR, "SPREAD_ROWS", 50)
    df = spark.range(200, numPartitions=1).selectExpr("id % 7 * 1.0d AS x", "CAST(id % 3 AS STRING) AS c", "CAST(id % 7 > 3 AS INT) AS label")
    tasks = []
    real = TR.RandomForestClassifier._fit
    monkeypatch.setattr(TR.RandomForestClassifier, "_fit", lambda self, rows: tasks.append(rows.rdd.getNumPartitions()) or real(self, rows))
    model = TR.fit(df, ["x"], ["c"], TR.forest(num_trees=3, max_depth=2))
    assert tasks == [min(4, spark.sparkContext.defaultParallelism)]
    p = TR.positive_probability(model, df, ["x", "label"]).collect()
    assert len(p) == 200 and all((r["p"] >= 0.5) == (r["label"] == 1) for r in p)
    monkeypatch.setattr(PR, "SPREAD_ROWS", 200)  # a small table stays as it is
    assert PR.spread(df, 200).rdd.getNumPartitions() == 1


def test_split_of_wide_rows_shuffles_ids_only(spark):
    """the same split as by ids, without a shuffle of the other columns."""
    from pyspark.sql import functions as F
    df = spark.range(0, 5003).selectExpr("id * 37 - 5000 AS application_id", "CASE WHEN id % 50 = 0 THEN NULL ELSE CAST(id % 3 = 0 AS INT) END AS label",
                                         "repeat('w', 50) AS wide")
    got = PR.with_split(df, "application_id", "label", 0.2)
    assert got.columns == ["application_id", "label", "wide", "is_test"]
    want = PR.stratified_split(df, "application_id", "label", 0.2).select(*got.columns)
    key = lambda rows: sorted(map(str, rows))
    assert key(got.collect()) == key(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("wide" in line for line in plan.split("\n") if "hashpartitioning" in line)
    assert PR.with_split(df.limit(0), "application_id", "label").count() == 0
    assert F is not None


def test_model_frame_of_repeated_ids(spark, tmp_path, monkeypatch):
    """ids that repeat, or are null, are joined as before: each row with each flag of its id."""
    from lendgov.plans import q_models as Q

    class V:
        stored = staticmethod(lambda name, build, modules=(): build())

    def frame(ids):
        rows = spark.createDataFrame([(i, int(i or 0) % 2) for i in ids], "application_id long, label int")
        monkeypatch.setattr(Q, "_model_frame", lambda v: rows)
        monkeypatch.setattr(Q, "_split", lambda v: PR.stratified_split(rows.withColumnRenamed("label", "Approved"), "application_id", "Approved", 0.2))
        return sorted(r.application_id for r in Q._split_frame(V).collect())

    assert frame([1, 2, 3, 4]) == [1, 2, 3, 4]
    assert frame([1, 2, 2, None]) == [1, 2, 2, 2, 2]
