"""Feature engineering (column math) for loan applications.

Training-time features use global statistics of the whole table (max income,
90th percentiles, min/max of the score). Each statistic is a one-row
aggregate broadcast back with a cross join of that single row, never an
unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import multi_quantiles

# Fixed model feature order: 13 numeric then 7 categorical (Credit_History last).
NUMERIC_FEATURES = ["ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term",
                    "mobile_usage_score", "transaction_stability_score", "bank_balance",
                    "total_income", "emi", "income_to_emi_ratio", "credit_utilization",
                    "stability_score", "cibil_proxy_score"]
CATEGORICAL_FEATURES = ["Gender", "Married", "Dependents", "Education", "Self_Employed",
                        "Property_Area", "Credit_History"]
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES


def term_or_one(term_col: str = "Loan_Amount_Term"):
    """A zero or missing term counts as one month."""
    t = F.coalesce(F.col(term_col), F.lit(0))
    return F.when(t == 0, F.lit(1)).otherwise(t)


def with_train_features(apps: DataFrame) -> DataFrame:
    """F1-F5 on the training view: income, EMI, ratio, utilisation, stability."""
    df = apps.select(
        "*",
        (F.coalesce("ApplicantIncome", F.lit(0)) + F.coalesce("CoapplicantIncome", F.lit(0)))
        .alias("total_income"),
        (F.col("LoanAmount").cast("double") / term_or_one()).alias("emi"),
        F.coalesce("Credit_History", F.lit(0)).alias("ch"))
    return df.select(
        "*",
        (F.col("total_income").cast("double") / (F.col("emi") + 1)).alias("income_to_emi_ratio"),
        (F.col("LoanAmount").cast("double") / (F.col("bank_balance") + 50000)).alias("credit_utilization"),
        F.expr("0.4e0 * (transaction_stability_score / 950e0) + 0.3e0 * (mobile_usage_score / 950e0)"
               " + 0.3e0 * ch").alias("stability_score"))


def global_stats(feat: DataFrame, accuracy: int = 10000) -> DataFrame:
    """One row: max income (F6) and the 90th percentiles used by the risk score (F8)."""
    mx = feat.agg(F.max("total_income").alias("max_income"))
    q = multi_quantiles(feat, [("income_to_emi_ratio", 0.9, "q_ratio"), ("bank_balance", 0.9, "q_bal")],
                        accuracy=accuracy)
    return mx.crossJoin(q)  # 1 x 1 rows


CIBIL_TRAIN = ("(0.35e0 * transaction_stability_score + 0.25e0 * mobile_usage_score"
               " + 0.2e0 * (CAST(total_income AS DOUBLE) / max_income * 900) + 0.2e0 * (ch * 900)) / 2")
RISK_SCORE = ("0.3e0 * (cibil_proxy_score / 900) + 0.25e0 * (income_to_emi_ratio / (q_ratio + 1))"
              " + 0.2e0 * ch + 0.15e0 * (bank_balance / (q_bal + 1)) - 0.1e0 * credit_utilization")
APPROVED_DRAW = ("CASE WHEN ((application_id * 7919 + 104729) % 10007) / 10007e0"
                 " < GREATEST(0.05e0, LEAST(0.95e0, probability)) THEN 1 ELSE 0 END")


def with_cibil_train(feat: DataFrame, stats: DataFrame) -> DataFrame:
    """income term scaled by the global max income."""
    return feat.crossJoin(F.broadcast(stats)).withColumn("cibil_proxy_score", F.expr(CIBIL_TRAIN))


def with_risk(feat: DataFrame, accuracy: int = 10000, stats: DataFrame | None = None) -> DataFrame:
    """F6 + F8 + F9 + P5 + the deterministic label. ``stats``: the row of ``global_stats``, where it is known already."""
    stats = global_stats(feat, accuracy) if stats is None else stats
    c = with_cibil_train(feat, stats)
    r = c.withColumn("risk_score", F.expr(RISK_SCORE))
    mm = r.agg(F.min("risk_score").alias("mn"), F.max("risk_score").alias("mx"))
    p = r.crossJoin(F.broadcast(mm)).withColumn(
        "probability", (F.col("risk_score") - F.col("mn")) / (F.col("mx") - F.col("mn") + F.lit(1e-6)))
    return p.withColumn("decision", decision_label("probability")) \
            .withColumn("Approved", F.expr(APPROVED_DRAW))


def decision_label(p_col: str, threshold: float = 0.5):
    """P5: approved when p >= threshold; NaN or null p is denied."""
    p = F.col(p_col)
    return F.when(p.isNotNull() & ~F.isnan(p) & (p >= threshold), F.lit("approved")) \
            .otherwise(F.lit("denied"))


def clip_probability(p_col: str, lo: float = 0.05, hi: float = 0.95):
    """F9 clip."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(p_col)))


def with_serve_features(apps: DataFrame) -> DataFrame:
    """Serving-time features.

    Missing or null inputs count as 0 (a zero term as 1); a value already
    present in the row wins over the computed one. The cibil proxy uses raw
    income (no global max), which is the serving formula.
    """
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    ti = z("ApplicantIncome") + z("CoapplicantIncome")
    term = F.coalesce(F.col("Loan_Amount_Term").cast("double"), F.lit(0.0))
    term = F.when(term == 0, F.lit(1.0)).otherwise(term)
    emi = z("LoanAmount") / term
    ratio = F.when(ti == 0, F.lit(0.0)).otherwise(ti / (emi + 1))
    util = z("LoanAmount") / (z("bank_balance") + 50000)
    ch = z("Credit_History")
    stab = F.lit(0.4) * (z("transaction_stability_score") / 950) + \
        F.lit(0.3) * (z("mobile_usage_score") / 950) + F.lit(0.3) * ch
    cibil = (F.lit(0.35) * z("transaction_stability_score") + F.lit(0.25) * z("mobile_usage_score")
             + F.lit(0.2) * ti + F.lit(0.2) * (ch * 900)) / 2
    computed = {"total_income": ti, "emi": emi, "income_to_emi_ratio": ratio,
                "credit_utilization": util, "stability_score": stab, "cibil_proxy_score": cibil}
    cols = []
    for name, expr in computed.items():
        if name in apps.columns:
            cols.append(F.coalesce(F.col(name).cast("double"), expr).alias(name))
        else:
            cols.append(expr.alias(name))
    keep = [c for c in apps.columns if c not in computed]
    return apps.select(*keep, *cols)
