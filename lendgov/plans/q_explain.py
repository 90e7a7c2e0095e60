"""Explanation and remediation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FX
from ..operators import explain as EX
from ..operators import remediation as RM
from ..operators import scoring as SC
from .common import round_doubles, views
from .registry import register

_INPUTS = [c for c, _, _ in SC.TERMS]
_RULE_INPUTS = ["ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term", "Credit_History",
                "cibil_proxy_score", "bank_balance", "mobile_usage_score", "transaction_stability_score",
                "credit_utilization"]


def explained(spark, sf_dir, extra=()):
    """Per application: sorted attributions, scorecard decision, reasons (+ ``extra`` columns carried)."""
    v = views(spark, sf_dir)
    src = v.scored.select("application_id", *dict.fromkeys(_INPUTS + list(extra)))
    rows = SC.attribution_rows(src, ["application_id"], extra=list(extra), fitted=v.scorecard_params)
    rows = rows.withColumn("attr", EX.sorted_attr(F.col("attr"))) \
               .withColumn("decision", FX.decision_label("p_approve"))
    return EX.reasons(rows)


def _long(df, col):
    # outer generator: a non-outer one makes the optimizer infer size(col) > 0 and push that
    # whole array expression into the join below, evaluating it twice
    return df.select("application_id", F.posexplode_outer(col).alias("pos", "r")).where(F.col("pos").isNotNull()).select(
        "application_id", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("r.feature").alias("feature"),
        F.col("r.shap").alias("shap"))


# ---- oracle SQL ----------------------------------------------------------------
def _attr_sql() -> str:
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in _INPUTS)
    fills = []
    for c, _, cap in SC.TERMS:
        e = f"COALESCE(CAST({c} AS DOUBLE), med_{c})"
        if cap is not None:
            e = f"LEAST({e}, CAST({cap!r} AS DOUBLE))"
        fills.append(f"{e} AS {c}, CAST({c} AS DOUBLE) AS own_{c}")
    means = ", ".join(f"AVG({c}) AS mean_{c}" for c in _INPUTS)
    z = " + ".join(f"CAST({w!r} AS DOUBLE) * {c}" for c, w, _ in SC.TERMS)
    unions = "\n  UNION ALL ".join(
        f"SELECT application_id, {SC.FEATURE_INDEX[c]} AS feature_idx, '{c}' AS feature, own_{c} AS value, "
        f"CAST({w!r} AS DOUBLE) * ({c} - mean_{c}) AS shap FROM f CROSS JOIN mu" for c, w, _ in SC.TERMS)
    return f"""
m AS (SELECT {meds} FROM risk_full),
f AS (SELECT application_id, {", ".join(fills)} FROM risk_full CROSS JOIN m),
mu AS (SELECT {means} FROM f),
dec AS (SELECT application_id, 1e0 / (1e0 + EXP(-(-2.0e0 + {z}))) AS p_approve,
               CASE WHEN 1e0 / (1e0 + EXP(-(-2.0e0 + {z}))) >= 0.5e0 THEN 'approved' ELSE 'denied' END AS decision FROM f),
attr AS ({unions}),
ranked AS (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY application_id ORDER BY ABS(shap) DESC, feature_idx) AS r_all,
  CASE WHEN shap < 0 THEN ROW_NUMBER() OVER (PARTITION BY application_id, shap < 0 ORDER BY ABS(shap) DESC, feature_idx) END AS r_neg,
  CASE WHEN shap > 0 THEN ROW_NUMBER() OVER (PARTITION BY application_id, shap > 0 ORDER BY ABS(shap) DESC, feature_idx) END AS r_pos
  FROM attr)"""


@register("linear_attribution", oracle=f"""
WITH {_attr_sql()}
SELECT application_id, feature_idx, feature, ROUND(value, 6) AS value, ROUND(shap, 6) AS shap FROM attr""",
          views=("risk_full",))
def linear_attribution(spark, sf_dir):
    v = views(spark, sf_dir)
    src = v.scored.select("application_id", *_INPUTS)
    return round_doubles(SC.attribution(src, ["application_id"], fitted=v.scorecard_params))


@register("shap_top_features", oracle=f"""
WITH {_attr_sql()} SELECT application_id, r_all AS rank, feature, ROUND(shap, 6) AS shap FROM ranked WHERE r_all <= 5""",
          views=("risk_full",))
def shap_top_features(spark, sf_dir):
    return round_doubles(_long(explained(spark, sf_dir), "top_features"))


@register("shap_top_negative", oracle=f"""
WITH {_attr_sql()} SELECT application_id, r_neg AS rank, feature, ROUND(shap, 6) AS shap FROM ranked WHERE r_neg <= 5""",
          views=("risk_full",))
def shap_top_negative(spark, sf_dir):
    return round_doubles(_long(explained(spark, sf_dir), "top_negative"))


@register("shap_top_positive", oracle=f"""
WITH {_attr_sql()} SELECT application_id, r_pos AS rank, feature, ROUND(shap, 6) AS shap FROM ranked WHERE r_pos <= 5""",
          views=("risk_full",))
def shap_top_positive(spark, sf_dir):
    return round_doubles(_long(explained(spark, sf_dir), "top_positive"))


# X7 in SQL, over decisions d and their main reason m.
SUMMARY_SQL = """CASE WHEN m.mr IS NULL THEN 'Loan ' || d.decision || ' based on the overall risk profile of your application.'
       ELSE 'Loan ' || d.decision || ' because ' || m.mr.feature || ' (' || COALESCE(printf('%.2f', m.mr.value), 'None') || ') '
            || CASE WHEN d.decision = 'approved' THEN 'supported your approval' ELSE 'reduced your approval score' END
            || ' by ' || printf('%.2f', m.mr.shap) || '.' END"""


@register("reason_summary", oracle=f"""
WITH {_attr_sql()},
mainr AS (SELECT application_id, arg_min(struct_pack(feature := feature, value := value, shap := shap),
                 CASE WHEN r_neg = 1 THEN 0 ELSE 1 END) AS mr
          FROM ranked WHERE r_neg = 1 OR r_pos = 1 GROUP BY 1)
SELECT d.application_id, d.decision, m.mr.feature AS main_feature, ROUND(m.mr.shap, 6) AS main_shap,
  {SUMMARY_SQL} AS summary,
  CASE WHEN m.mr IS NULL THEN 'Loan ' || d.decision || ' based on the overall risk profile from your data.'
       ELSE 'Loan ' || d.decision || ' because ' || m.mr.feature || ' (' || COALESCE(printf('%.2f', m.mr.value), 'None') || ') '
            || CASE WHEN d.decision = 'approved' THEN 'supported your approval' ELSE 'lowered your score the most' END
            || '.' END AS summary_plain
FROM dec d LEFT JOIN mainr m ON d.application_id = m.application_id""", views=("risk_full",))
def reason_summary(spark, sf_dir):
    e = EX.primary(explained(spark, sf_dir))
    return round_doubles(e.select("application_id", "decision", "main_feature", "main_shap",
                                  EX.summary(F.col("decision"), True).alias("summary"),
                                  EX.summary(F.col("decision"), False).alias("summary_plain")))


@register("shap_reasons", oracle=f"""
WITH {_attr_sql()},
mainr AS (SELECT application_id, arg_min(struct_pack(feature := feature, value := value, shap := shap),
                 CASE WHEN r_neg = 1 THEN 0 ELSE 1 END) AS mr
          FROM ranked WHERE r_neg = 1 OR r_pos = 1 GROUP BY 1),
lists AS (SELECT application_id, 'top_features' AS list, r_all AS rank, feature, value, shap FROM ranked WHERE r_all <= 5
          UNION ALL SELECT application_id, 'top_negative', r_neg, feature, value, shap FROM ranked WHERE r_neg <= 5
          UNION ALL SELECT application_id, 'top_positive', r_pos, feature, value, shap FROM ranked WHERE r_pos <= 5)
SELECT d.application_id, d.decision, ROUND(d.p_approve, 6) AS p_approve, {SUMMARY_SQL} AS summary,
       l.list, l.rank, l.feature, ROUND(l.value, 6) AS value, ROUND(l.shap, 6) AS shap
FROM dec d LEFT JOIN mainr m ON d.application_id = m.application_id JOIN lists l ON d.application_id = l.application_id""",
          views=("risk_full",))
def shap_reasons(spark, sf_dir):
    """E5 bundle: summary and the three reason lists per application, one row per listed reason."""
    e = explained(spark, sf_dir).withColumn("summary", EX.summary(F.col("decision"), True))
    lists = F.explode(F.flatten(F.array(*[_listed(c) for c in ("top_features", "top_negative", "top_positive")])))
    return round_doubles(e.select("application_id", "decision", "p_approve", "summary", lists.alias("r")).select(
        "application_id", "decision", "p_approve", "summary", "r.list", "r.rank", "r.feature", "r.value", "r.shap"))


def _listed(name: str):
    """A reason list with its name and ranks."""
    return F.transform(F.col(name), lambda r, i: F.struct(
        F.lit(name).alias("list"), (i + 1).cast("bigint").alias("rank"), r["feature"].alias("feature"), r["value"].alias("value"), r["shap"].alias("shap")))


def _family_case(expr: str) -> str:
    whens = []
    for keys, text in RM.REASON_FAMILIES:
        cond = " OR ".join(f"lower({expr}) LIKE '%{k}%'" for k in keys)
        whens.append(f"WHEN {cond} THEN '{text}'")
    return "CASE " + " ".join(whens) + " END"


def _rules_sql() -> str:
    n = lambda c: f"COALESCE(CAST({c} AS DOUBLE), 0.0e0)"
    term = f"(CASE WHEN {n('Loan_Amount_Term')} = 0 THEN 1.0e0 ELSE {n('Loan_Amount_Term')} END)"
    emi = f"({n('LoanAmount')} / {term})"
    ti = f"({n('ApplicantIncome')} + {n('CoapplicantIncome')})"
    cib = n("cibil_proxy_score")
    rules = [
        (f"{ti} > 0 AND {emi} / GREATEST({ti}, 1.0e0) > 0.4e0", RM.ADVICE_EMI),
        (f"COALESCE(Credit_History = 0, FALSE) OR ({cib} <> 0 AND {cib} < 600)", RM.ADVICE_RISK_BAND),
        (f"{ti} <> 0 AND {ti} < 40000", RM.ADVICE_LOW_INCOME),
        (f"{n('bank_balance')} < 25000", RM.ADVICE_BALANCE),
        (f"{n('mobile_usage_score')} < 500 OR {n('transaction_stability_score')} < 500", RM.ADVICE_DIGITAL),
        (f"{n('credit_utilization')} > 5", RM.ADVICE_BORROWING),
    ]
    thr = "\n  UNION ALL ".join(
        f"SELECT application_id, {100 + i} AS pos, CASE WHEN {cond} THEN '{text}' END AS step FROM risk_full"
        for i, (cond, text) in enumerate(rules))
    return f"""
WITH {_attr_sql()},
cand AS (
  SELECT application_id, r_neg AS pos, {_family_case('feature')} AS step FROM ranked WHERE r_neg <= 5
  UNION ALL {thr}),
firsts AS (SELECT application_id, step, MIN(pos) AS pos FROM cand WHERE step IS NOT NULL GROUP BY 1, 2),
numbered AS (SELECT application_id, step, ROW_NUMBER() OVER (PARTITION BY application_id ORDER BY pos) AS step_no FROM firsts),
apps AS (SELECT application_id FROM risk_full)
SELECT application_id, step_no, step FROM numbered WHERE step_no <= 6
UNION ALL
SELECT application_id, 1, '{RM.ADVICE_GENERIC}' FROM apps WHERE application_id NOT IN (SELECT application_id FROM firsts)"""


def _steps_long(df, col):
    return df.select("application_id", F.posexplode_outer(col).alias("pos", "step")).select(
        "application_id", (F.col("pos") + 1).cast("bigint").alias("step_no"), "step")


@register("remediation_rules", oracle=_rules_sql(), views=("risk_full",))
def remediation_rules(spark, sf_dir):
    e = explained(spark, sf_dir, extra=_RULE_INPUTS)
    return _steps_long(e.select("application_id", RM.rule_steps().alias("steps")), "steps")


@register("remediation_templates", oracle=f"""
WITH {_attr_sql()},
cand AS (SELECT application_id, r_neg AS pos,
  CASE {" ".join(f"WHEN contains(feature, '{k}') THEN '{t}'" for k, t in RM.TEMPLATES)}
  ELSE 'Try to improve the underlying factor ''' || feature || ''' by lowering risk (e.g., reducing debt, increasing income stability, or adding collateral).' END AS step
  FROM ranked WHERE r_neg <= 5),
firsts AS (SELECT application_id, step, MIN(pos) AS pos FROM cand GROUP BY 1, 2),
numbered AS (SELECT application_id, step, ROW_NUMBER() OVER (PARTITION BY application_id ORDER BY pos) AS step_no FROM firsts)
SELECT application_id, step_no, step FROM numbered
UNION ALL
SELECT application_id, 1, '{RM.TEMPLATE_GENERIC}' FROM risk_full WHERE application_id NOT IN (SELECT application_id FROM firsts)""",
          views=("risk_full",))
def remediation_templates(spark, sf_dir):
    e = explained(spark, sf_dir)
    return _steps_long(e.select("application_id", RM.template_steps().alias("steps")), "steps")
