from pyspark.sql import functions as F

from lendgov.operators import fairness as FA
from lendgov.operators import monitoring as MO


def _rates(spark, rates):
    return spark.createDataFrame([("a", str(i), 10, float(r), 0.0) for i, r in enumerate(rates)],
                                 "sensitive_feature string, group_value string, n_rows long, "
                                 "selection_rate double, overall_selection_rate double")


def test_alert_thresholds_strict(spark):
    # ratio exactly 0.8 -> no DI alert; difference 0.2 -> no SPD alert (strict > in doubles)
    a = FA.bias_alerts(FA.disparity(_rates(spark, [0.8, 1.0]))).collect()
    assert a == []


def test_alert_both(spark):
    a = FA.bias_alerts(FA.disparity(_rates(spark, [0.4, 0.9]))).orderBy("alert_order").collect()
    assert [r.metric for r in a] == ["disparate_impact", "statistical_parity_difference"]


def test_all_zero_rates_no_alert(spark):
    d = FA.disparity(_rates(spark, [0.0, 0.0])).collect()[0]
    assert d.disparate_impact is None
    assert FA.bias_alerts(FA.disparity(_rates(spark, [0.0, 0.0]))).count() == 0


def test_selection_rates_null_group(spark):
    df = spark.createDataFrame([("M", 1), ("M", 0), (None, 1)], "g string, y int")
    r = {x.group_value: x.selection_rate for x in FA.selection_rates(df, ["g"], "y").collect()}
    assert r == {"M": 0.5, "nan": 1.0}


def test_pick_sensitive(spark):
    df = spark.createDataFrame([(1, "x")], "personal_status int, other string")
    assert FA.pick_sensitive(df) == "personal_status"
    assert FA.pick_sensitive(df.drop("personal_status")) is None


def test_risk_buckets_edge_rows(spark):
    vals = ["0.7", "0.3", "0.29999", None, "", "None", "abc", "nan"]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    b = [r[0] for r in df.select(MO.risk_bucket(F.col("p"))).collect()]
    assert b == [0, 1, 2, 2, 2, None, None, 2]
    dist = {r.category: r.n for r in MO.risk_distribution(df, "p").collect()}
    assert dist == {"Low Risk (High Prob)": 1, "Medium Risk": 1, "High Risk (Low Prob)": 4}


def test_summary_empty(spark):
    df = spark.createDataFrame([], "decision string")
    r = MO.summary(df).collect()[0]
    assert (r.total, r.approval_rate) == (0, 0.0)


def test_permutation_invariance(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["M", "F", None]), st.integers(0, 1)), min_size=1, max_size=40),
           st.randoms())
    def check(rows, rnd):
        shuffled = list(rows)
        rnd.shuffle(shuffled)
        a = FA.selection_rates(spark.createDataFrame(rows, "g string, y int"), ["g"], "y").collect()
        b = FA.selection_rates(spark.createDataFrame(shuffled, "g string, y int"), ["g"], "y").collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))
        s1 = MO.summary(spark.createDataFrame([("approved" if y else "denied",) for _, y in rows], "decision string"))
        s2 = MO.summary(spark.createDataFrame([("approved" if y else "denied",) for _, y in shuffled], "decision string"))
        assert s1.collect() == s2.collect()

    check()
