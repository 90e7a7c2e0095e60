"""Feature, scoring-view and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FX
from ..operators import quality as QA
from .common import round_doubles, views
from .registry import register

_FEAT_COLS = ["total_income", "emi", "income_to_emi_ratio", "credit_utilization", "stability_score",
              "cibil_proxy_score"]


@register("applications", oracle="SELECT * FROM applications", views=("applications",))
def applications(spark, sf_dir):
    return views(spark, sf_dir).applications


@register("features_train", oracle="""
SELECT application_id, total_income, ROUND(emi, 6) AS emi, ROUND(income_to_emi_ratio, 6) AS income_to_emi_ratio,
       ROUND(credit_utilization, 6) AS credit_utilization, ROUND(stability_score, 6) AS stability_score,
       ROUND(cibil_proxy_score, 6) AS cibil_proxy_score FROM risk""", views=("risk",))
def features_train(spark, sf_dir):
    return round_doubles(views(spark, sf_dir).risk.select("application_id", *_FEAT_COLS))


@register("risk_score", oracle="""
SELECT application_id, ROUND(risk_score, 6) AS risk_score, ROUND(q_ratio, 6) AS q_ratio, ROUND(q_bal, 6) AS q_bal
FROM risk_full""", views=("risk_full",))
def risk_score(spark, sf_dir):
    v = views(spark, sf_dir)
    stats = FX.global_stats(v.features)
    r = FX.with_cibil_train(v.features, stats).withColumn("risk_score", F.expr(FX.RISK_SCORE))
    return round_doubles(r.select("application_id", "risk_score", "q_ratio", "q_bal"))


@register("approval_prob", oracle="""
SELECT application_id, ROUND(probability, 6) AS probability,
       ROUND(GREATEST(0.05e0, LEAST(0.95e0, probability)), 6) AS clipped_probability, Approved FROM risk""",
          views=("risk",))
def approval_prob(spark, sf_dir):
    r = views(spark, sf_dir).risk
    return round_doubles(r.select("application_id", "probability",
                                  FX.clip_probability("probability").alias("clipped_probability"),
                                  "Approved"))


@register("decisions", oracle="""
SELECT application_id, ROUND(probability, 6) AS probability, decision FROM risk""", views=("risk",))
def decisions(spark, sf_dir):
    r = views(spark, sf_dir).risk
    return round_doubles(r.select("application_id", "probability", FX.decision_label("probability").alias("decision")))


_SERVE_SQL = """
WITH z AS (
  SELECT application_id,
   COALESCE(CAST(ApplicantIncome AS DOUBLE), 0) + COALESCE(CAST(CoapplicantIncome AS DOUBLE), 0) AS ti,
   COALESCE(CAST(LoanAmount AS DOUBLE), 0) / (CASE WHEN COALESCE(CAST(Loan_Amount_Term AS DOUBLE), 0) = 0 THEN 1.0e0
        ELSE CAST(Loan_Amount_Term AS DOUBLE) END) AS emi,
   COALESCE(CAST(LoanAmount AS DOUBLE), 0) / (COALESCE(CAST(bank_balance AS DOUBLE), 0) + 50000) AS util,
   COALESCE(CAST(Credit_History AS DOUBLE), 0) AS ch,
   COALESCE(CAST(transaction_stability_score AS DOUBLE), 0) AS txn,
   COALESCE(CAST(mobile_usage_score AS DOUBLE), 0) AS mob
  FROM applications)
SELECT application_id, ROUND(ti, 6) AS total_income, ROUND(emi, 6) AS emi,
  ROUND(CASE WHEN ti = 0 THEN 0.0e0 ELSE ti / (emi + 1) END, 6) AS income_to_emi_ratio,
  ROUND(util, 6) AS credit_utilization,
  ROUND(0.4e0 * (txn / 950) + 0.3e0 * (mob / 950) + 0.3e0 * ch, 6) AS stability_score,
  ROUND((0.35e0 * txn + 0.25e0 * mob + 0.2e0 * ti + 0.2e0 * (ch * 900)) / 2, 6) AS cibil_proxy_score
FROM z"""


@register("features_serve", oracle=_SERVE_SQL, views=("applications",))
def features_serve(spark, sf_dir):
    apps = views(spark, sf_dir).applications
    s = FX.with_serve_features(apps)
    return round_doubles(s.select("application_id", *_FEAT_COLS))


@register("feature_projection", oracle="""
SELECT application_id, CAST(NULL AS DOUBLE) AS ApplicantIncome, CAST(NULL AS DOUBLE) AS CoapplicantIncome, LoanAmount,
  CAST(NULL AS DOUBLE) AS Loan_Amount_Term, mobile_usage_score, transaction_stability_score, bank_balance, total_income,
  ROUND(emi, 6) AS emi, ROUND(income_to_emi_ratio, 6) AS income_to_emi_ratio, ROUND(credit_utilization, 6) AS credit_utilization,
  ROUND(stability_score, 6) AS stability_score, ROUND(cibil_proxy_score, 6) AS cibil_proxy_score, Gender,
  CAST(NULL AS VARCHAR) AS Married, CAST(NULL AS VARCHAR) AS Dependents, CAST(NULL AS VARCHAR) AS Education,
  CAST(NULL AS VARCHAR) AS Self_Employed, Property_Area, Credit_History FROM risk""", views=("risk",))
def feature_projection(spark, sf_dir):
    r = views(spark, sf_dir).risk
    return round_doubles(QA.project_features(r, keys=("application_id",)))


_CHECKING_LABEL = (
    "CASE WHEN bank_balance = 0 THEN 'No current account' WHEN bank_balance < 25000 THEN 'Current balance < ₹25,000'"
    " WHEN bank_balance < 100000 THEN '₹25,000 – ₹1,00,000' ELSE '> ₹1,00,000' END")
_HISTORY_LABEL = ("CASE WHEN Credit_History = 1 THEN 'Good (no major defaults)' ELSE 'Weak / past defaults' END")


def _option_label(mapping: dict, at: str) -> str:
    """A label picked by ``at`` modulo one more than there are options (the last: a label that no form offers)."""
    options = [*mapping, "Something else"]
    return f"CASE CAST(({at}) % {len(options)} AS INT) " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options)) + " END"


_RECODED = {
    "checking": (_CHECKING_LABEL, QA.CHECKING_OPTIONS),
    "purpose": (_option_label(QA.PURPOSE_OPTIONS, "application_id"), QA.PURPOSE_OPTIONS),
    "savings": (_option_label(QA.SAVINGS_OPTIONS, "applicant_id"), QA.SAVINGS_OPTIONS),
    "employment": (_option_label(QA.EMPLOYMENT_OPTIONS, "application_id + applicant_id"), QA.EMPLOYMENT_OPTIONS),
}


def _code_sql(name: str) -> str:
    return f"CASE {name}_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _RECODED[name][1].items()) + " END"


@register("label_recode", oracle=f"""
SELECT application_id, {', '.join(f'{n}_label, {_code_sql(n)} AS {n}_code' for n in _RECODED)},
  credit_history_label, CASE WHEN credit_history_label LIKE '%Good%' THEN 1 ELSE 0 END AS credit_history_code
FROM (SELECT application_id, {', '.join(f'{label} AS {n}_label' for n, (label, _) in _RECODED.items())}, {_HISTORY_LABEL} AS credit_history_label
      FROM applications) x""", views=("applications",))
def label_recode(spark, sf_dir):
    """The form's labels for account, purpose, savings and employment as the model's codes; a label that is not offered has none."""
    a = views(spark, sf_dir).applications
    lab = a.select("application_id", *[F.expr(label).alias(f"{n}_label") for n, (label, _) in _RECODED.items()], F.expr(_HISTORY_LABEL).alias("credit_history_label"))
    codes = [c for n, (_, options) in _RECODED.items() for c in (F.col(f"{n}_label"), QA.recode(F.col(f"{n}_label"), options).alias(f"{n}_code"))]
    return lab.select("application_id", *codes, "credit_history_label", QA.credit_history_code(F.col("credit_history_label")).alias("credit_history_code"))


def _dv_sql():
    parts = []
    for i, (c, lo, hi) in enumerate(QA.NUMERIC_DOMAINS):
        parts.append(f"SELECT {i} AS rule_order, '{c}' AS column_name, 'range' AS rule, "
                     f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null, "
                     f"CAST(COUNT(*) FILTER (WHERE NOT ({c} BETWEEN {lo} AND {hi})) AS BIGINT) AS n_violations FROM applications")
    base = len(QA.NUMERIC_DOMAINS)
    for j, (c, allowed) in enumerate(QA.CATEGORY_DOMAINS):
        lst = ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in allowed)
        parts.append(f"SELECT {base + j}, '{c}', 'category', CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT), "
                     f"CAST(COUNT(*) FILTER (WHERE NOT ({c} IN ({lst}))) AS BIGINT) FROM applications")
    return "\nUNION ALL\n".join(parts)


@register("domain_violations", oracle=_dv_sql(), views=("applications",))
def domain_violations(spark, sf_dir):
    return QA.domain_violations(views(spark, sf_dir).applications)
