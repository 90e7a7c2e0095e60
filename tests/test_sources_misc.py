import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lendgov.operators import explain as EX
from lendgov.operators import fairness as FA
from lendgov.operators import prep as PR
from lendgov.operators import training as TR
from lendgov.sources import files as FS


def test_csv_round_trip_and_header(spark):
    d = tempfile.mkdtemp(prefix="lendgov-test-")
    df = spark.createDataFrame([(1000, 0, 50000, 12, 1, "Male")],
                               "ApplicantIncome long, CoapplicantIncome long, LoanAmount long, "
                               "Loan_Amount_Term long, Credit_History int, Gender string")
    p = os.path.join(d, "loans.csv")
    FS.write_csv(df, p)
    assert FS.header_columns(spark, p)[:2] == ["ApplicantIncome", "CoapplicantIncome"]
    back = FS.read_loans_csv(spark, p)
    r = back.collect()[0]
    assert r.LoanAmount == 50000 and r.Gender == "Male" and r.bank_balance is None


def test_append_table_partitioned(spark):
    d = tempfile.mkdtemp(prefix="lendgov-test-")
    df = spark.createDataFrame([("bias-alert", 1), ("decision", 2)], "event_type string, v int")
    FS.append_table(df, d, "event_type")
    FS.append_table(df, d, "event_type")
    back = spark.read.parquet(d)
    assert back.where("event_type = 'decision'").count() == 2


def test_model_save_load(spark):
    d = tempfile.mkdtemp(prefix="lendgov-test-")
    df = spark.createDataFrame([(float(i), "a" if i % 2 else "b", i % 2) for i in range(40)],
                               "x double, c string, label int")
    m = TR.fit(df, ["x"], ["c"], TR.logistic(40))
    TR.save(m, os.path.join(d, "model"), ["x", "c"])
    assert TR.load_features(os.path.join(d, "model")) == ["x", "c"]
    m2 = TR.load(os.path.join(d, "model"))
    a = TR.positive_probability(m, df, ["x"]).collect()
    b = TR.positive_probability(m2, df, ["x"]).collect()
    assert a == b


def test_credit_g_fairness_flow(spark):
    df = spark.createDataFrame([("good", "male", 0.9), ("bad", "female", 0.2), ("good", "female", 0.7)],
                               "class string, sex string, p double")
    info, rates = FA.dataset_fairness(df, F.col("p"))
    assert info["available"] and info["sensitive_feature"] == "sex"
    r = {x.group_value: x.selection_rate for x in rates.collect()}
    assert r == {"male": 1.0, "female": 0.5}
    info2, none = FA.dataset_fairness(df.drop("class"), F.col("p"))
    assert not info2["available"] and none is None


def test_split_by_dtype_and_zero_attribution(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a long, b double, c string")
    assert PR.split_by_dtype(df, exclude=["a"]) == (["b"], ["c"])
    z = EX.zero_attribution(df.withColumnRenamed("a", "application_id"), ["b"]).collect()[0]
    assert z.attr[0].shap == 0.0


def test_registry_file_and_malformed(spark):
    d = tempfile.mkdtemp(prefix="lendgov-test-")
    good = os.path.join(d, "good.json")
    with open(good, "w") as f:
        f.write('{\n "version": "v9", "dataset": "x.csv",\n "metrics": {"auc": 0.5, "accuracy": 0.6},\n'
                ' "metadata": {"target": "Approved"}\n}\n')
    r = FS.read_model_version(spark, good).collect()[0]
    assert (r.version, r.metrics.auc, r.metadata.target) == ("v9", 0.5, "Approved")
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        f.write("{ not json")
    assert FS.read_model_version(spark, bad).collect()[0].version == "indian_v1"


def test_checkpoint_dir_when_unset():
    from lendgov import session as S

    class Conf:
        def get(self, k, d=None):
            return None

        def set(self, k, v):
            raise RuntimeError("static config")

    class SC:
        applicationId = "app-x"

        def __init__(self, master="local[2]"):
            self.d = None
            self.master = master

        def getCheckpointDir(self):
            return self.d

        def setCheckpointDir(self, d):
            self.d = d

    class Fake:
        conf = Conf()
        sparkContext = SC()

    f = Fake()
    d1 = S.ensure_checkpoint_dir(f)
    assert os.path.isdir(d1) and f.sparkContext.d == d1
    assert S.ensure_checkpoint_dir(f) == d1
    f.sparkContext = SC("spark://host:7077")  # no machine-local folder on a cluster
    with pytest.raises(ValueError):
        S.ensure_checkpoint_dir(f)


def test_materialize_failure_is_raised(spark, monkeypatch):
    from lendgov.sources import materialize as M
    from lendgov.sources.derived import Views

    def boom(*a, **k):
        raise OSError("shared folder not writable")

    monkeypatch.setattr(M, "materialized", boom)
    with pytest.raises(OSError):
        Views(spark, "/root/testdata/sf0.001").scored.count()
    assert Views(spark, "/root/testdata/sf0.001", materialize=False).scored.count() == 1500


def test_replaced_nested_file_changes_the_key(spark, tmp_path):
    from lendgov.sources import materialize as M
    d = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id % 2 AS p").write.partitionBy("p").parquet(d)
    before = M.signature(spark, [d], [], "")
    assert before == M.signature(spark, [d], [], "")
    spark.range(20).selectExpr("id").write.mode("overwrite").parquet(os.path.join(d, "p=1"))
    assert M.signature(spark, [d], [], "") != before


def test_lost_race_leaves_one_clean_table(spark, tmp_path):
    from lendgov.sources import materialize as M
    path, one, two = (str(tmp_path / x) for x in ("t", "t.tmp-1", "t.tmp-2"))
    spark.range(3).write.parquet(one)
    spark.range(5).write.parquet(two)
    fs, p = M._fs(spark, path)
    assert M.publish(fs, M._fs(spark, one)[1], p)
    assert not M.publish(fs, M._fs(spark, two)[1], p)  # sees the other table
    assert sorted(os.listdir(tmp_path)) == ["t"] and spark.read.parquet(path).count() == 3

    class Blind:  # both looked before either renamed: the later rename moves the folder into the table
        def __init__(self):
            self.seen = 0

        def exists(self, q):
            self.seen += 1
            return False if self.seen == 1 else fs.exists(q)

        def __getattr__(self, name):
            return getattr(fs, name)

    spark.range(7).write.parquet(two)
    assert not M.publish(Blind(), M._fs(spark, two)[1], p)
    assert sorted(os.listdir(tmp_path)) == ["t"] and not [x for x in os.listdir(path) if "tmp" in x] and spark.read.parquet(path).count() == 3


def test_bad_event_is_null_not_an_error(spark, tmp_path):
    from lendgov.sources.derived import Views
    source, d = "/root/testdata/sf0.001", tmp_path / "sf"
    d.mkdir()
    for name in os.listdir(source):
        if name != "events.parquet":
            os.symlink(os.path.join(source, name), d / name)
    ev = spark.read.parquet(f"{source}/events.parquet")
    ev.limit(20).withColumn("props", F.when(F.col("event_id") % 2 == 0, F.lit('{"k": "x"}')).otherwise(F.col("props"))) \
        .write.parquet(str(d / "events.parquet"))
    v = Views(spark, str(d))
    assert v.consent_events.count() == 20


def test_only_raw_columns_are_sorted(spark):
    """The local sort by decision time holds the raw columns, not the wide scored rows; stored tables are compressed well."""
    from lendgov.sources.derived import Views
    v = Views(spark, "/root/testdata/sf0.001", materialize=False)
    plan = v.build_scored()._jdf.queryExecution().optimizedPlan().toString().split("\n")
    sorts = [i for i, line in enumerate(plan) if "Sort [" in line]
    assert sorts and all("o_orderdate" in plan[i] for i in sorts)
    assert not any("mobile_usage_score" in line for i in sorts for line in plan[i + 1:i + 3])
    days = [r.submitted_at for r in v.features.select("submitted_at").coalesce(1).collect()]
    assert len(days) == v.t.orders.count()
    stored = Views(spark, "/root/testdata/sf0.001").scored
    import pyarrow.parquet as pq
    path = stored.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert pq.ParquetFile(path).metadata.row_group(0).column(0).compression == "ZSTD"
