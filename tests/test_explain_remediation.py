from pyspark.sql import functions as F

from lendgov.operators import explain as EX
from lendgov.operators import remediation as RM


def _attr_row(spark, shaps, decision="denied"):
    arr = [(-abs(float(s)), i, f"f{i}", float(i), float(s)) for i, s in enumerate(shaps)]
    df = spark.createDataFrame([(1, arr, decision)], "id long, attr array<struct<sort_key:double,feature_idx:int,"
                                                     "feature:string,value:double,shap:double>>, decision string")
    return EX.reasons(df.withColumn("attr", EX.sorted_attr(F.col("attr"))))


def test_ties_keep_feature_order(spark):
    r = _attr_row(spark, [0.1, -0.3, 0.3, 0.0]).collect()[0]
    assert [x.feature for x in r.top_features] == ["f1", "f2", "f0", "f3"]
    assert [x.feature for x in r.top_negative] == ["f1"]
    assert [x.feature for x in r.top_positive] == ["f2", "f0"]


def test_summary_no_negative_and_all_zero(spark):
    r = _attr_row(spark, [0.2, 0.1], "approved").select(EX.summary(F.col("decision")).alias("s")).collect()[0]
    assert r.s == "Loan approved because f0 (0.00) supported your approval by 0.20."
    z = _attr_row(spark, [0.0, 0.0]).select(EX.summary(F.col("decision")).alias("s"),
                                            EX.summary(F.col("decision"), False).alias("p")).collect()[0]
    assert z.s == "Loan denied based on the overall risk profile of your application."
    assert z.p == "Loan denied based on the overall risk profile from your data."


def _steps(spark, features, **inputs):
    cols = {"ApplicantIncome": 100000, "CoapplicantIncome": 0, "LoanAmount": 100000, "Loan_Amount_Term": 100,
            "Credit_History": 1, "cibil_proxy_score": 700.0, "bank_balance": 100000, "mobile_usage_score": 700,
            "transaction_stability_score": 700, "credit_utilization": 1.0}
    cols.update(inputs)
    neg = [(f, 0.0, -1.0) for f in features]
    schema = ("top_negative array<struct<feature:string,value:double,shap:double>>, " +
              ", ".join(f"{k} double" for k in cols))
    df = spark.createDataFrame([(neg, *[float(v) if v is not None else None for v in cols.values()])], schema)
    return df.select(RM.rule_steps().alias("s"), RM.template_steps().alias("t")).collect()[0]


def test_nothing_fires_generic(spark):
    r = _steps(spark, [])
    assert r.s == [RM.ADVICE_GENERIC]
    assert r.t == [RM.TEMPLATE_GENERIC]


def test_dedupe_and_cap(spark):
    feats = ["LoanAmount", "emi", "Credit_History", "ApplicantIncome", "bank_balance", "mobile_usage_score"]
    r = _steps(spark, feats, bank_balance=100, mobile_usage_score=100, credit_utilization=9.0, Credit_History=0)
    assert len(r.s) == 6 and len(set(r.s)) == 6
    assert r.s[0] == RM.REASON_FAMILIES[0][1]


def test_family_order_quirks(spark):
    r = _steps(spark, ["income_to_emi_ratio", "total_income", "stability_score"])
    assert r.s[:2] == [RM.REASON_FAMILIES[0][1], RM.REASON_FAMILIES[3][1]]


def test_template_match(spark):
    r = _steps(spark, ["credit_amount", "age_years", "weird"])
    assert r.t[0] == RM.TEMPLATES[1][1] and r.t[1] == RM.TEMPLATES[2][1]
    assert "'weird'" in r.t[2]
