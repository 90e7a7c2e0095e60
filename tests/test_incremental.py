"""Derived tables that follow a growing folder, against full builds."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendgov.functions import features as FX
from lendgov.sources.derived import RAW_FEATURES
from lendgov.sources.incremental import AppendedLoans, AppendedTable, value_bin


def test_bins_rise_with_values(spark):
    rng = random.Random(2)
    values = sorted([0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, -1.0] + [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-9, 9) for _ in range(2000)])
    bins = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").withColumn("b", value_bin(F.col("x"))).orderBy("i").collect()]
    assert bins == sorted(bins) and len(set(bins)) > 1000


def table(spark, tmp_path, rows):
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    t = AppendedTable(spark, src, store, lambda df: df.select("*"), ["x"])
    for part in rows:
        spark.createDataFrame([(v,) for v in part], "x double").coalesce(1).write.mode("append").parquet(src)
        t.refresh()
    return t, src


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_exact_after_appends(spark, tmp_path, seed):
    rng = random.Random(seed)
    parts = [[rng.choice([3.0, 3.0, rng.gauss(0, 50), None]) for _ in range(rng.randrange(1, 200))] for _ in range(3)]
    t, _ = table(spark, tmp_path, parts)
    flat = [v for p in parts for v in p if v is not None]
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = t.quantiles([("x", p, f"q{i}") for i, p in enumerate(probs)]).first()
    assert [got[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(flat, probs)), rel=1e-12)
    assert t.maximum("x", "m").first()[0] == max(flat)


def test_only_new_files_are_read_and_lost_ones_are_left_out(spark, tmp_path):
    t, src = table(spark, tmp_path, [[1.0, 2.0], [10.0]])
    assert t.refresh() == [] and t.rows.count() == 3
    again = AppendedTable(spark, src, t.store, t.derive, ["x"])
    assert again.refresh() == []
    spark.createDataFrame([(100.0,)], "x double").coalesce(1).write.mode("append").parquet(src)
    assert len(again.refresh()) == 1 and again.maximum("x", "m").first()[0] == 100.0
    gone = next(os.path.join(src, f) for f in sorted(os.listdir(src)) if f.endswith(".parquet") and spark.read.parquet(os.path.join(src, f)).first()[0] == 100.0)
    os.remove(gone)
    assert again.refresh() == [] and again.maximum("x", "m").first()[0] == 10.0 and again.rows.count() == 3


def test_a_refresh_that_broke_off_is_done_again(spark, tmp_path):
    t, src = table(spark, tmp_path, [[1.0, 2.0]])
    spark.createDataFrame([(5.0,), (6.0,)], "x double").coalesce(1).write.mode("append").parquet(src)
    broken = AppendedTable(spark, src, t.store, t.derive, ["x"])
    broken._statistics = lambda rows: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        broken.refresh()
    assert len(t.refresh()) == 1 and t.rows.count() == 4 and t.merged().agg(F.sum("n")).first()[0] == 4


def test_scores_equal_a_full_build(spark, tmp_path):
    from conftest import SF_SMALL
    from lendgov.plans.common import views
    apps = views(spark, SF_SMALL).applications.select("application_id", "applicant_id", "submitted_at", *RAW_FEATURES)
    src = str(tmp_path / "src")
    loans = AppendedLoans(spark, src, str(tmp_path / "store"))
    for part in range(2):
        apps.where(F.col("application_id") % 2 == part).write.mode("append").parquet(src)
        loans.refresh()
    cols = ["application_id", "risk_score", "probability", "decision", "Approved"]
    got, want = (sorted(map(tuple, df.select(*cols).collect())) for df in (loans.scored(), FX.with_risk(FX.with_train_features(apps))))
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[3:] == w[3:] and g[1:3] == pytest.approx(w[1:3], abs=1e-12)
