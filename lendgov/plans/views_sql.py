"""DuckDB SQL text of the derived views, used only by the oracle check.

The derivation rules are the same fixed values as ``sources/derived.py``.
"""

APPLICATIONS = """
SELECT o.o_orderkey AS application_id, o.o_custkey AS applicant_id, o.o_orderdate AS submitted_at,
 CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE CAST(FLOOR(15000 + (c.c_acctbal + 1000) * 16) AS BIGINT) END AS ApplicantIncome,
 CAST((o.o_orderkey * 7919) % 150000 AS BIGINT) AS CoapplicantIncome,
 CAST(GREATEST(50000, FLOOR(o.o_totalprice * 5)) AS BIGINT) AS LoanAmount,
 CASE WHEN o.o_orderkey % 97 = 0 THEN 0 ELSE CAST(12 + (o.o_orderkey * 31) % 348 AS BIGINT) END AS Loan_Amount_Term,
 CASE WHEN o.o_orderkey % 61 = 0 THEN NULL WHEN (o.o_orderkey * 17 + o.o_custkey) % 4 = 0 THEN 0 ELSE 1 END AS Credit_History,
 CASE WHEN o.o_orderkey % 71 = 0 THEN NULL WHEN o.o_custkey % 10 < 7 THEN 'Male' ELSE 'Female' END AS Gender,
 CASE WHEN (c.c_nationkey * 3 + o.o_custkey) % 10 < 6 THEN 'Yes' ELSE 'No' END AS Married,
 CASE o.o_orderpriority WHEN '1-URGENT' THEN '0' WHEN '2-HIGH' THEN '0' WHEN '3-MEDIUM' THEN '1' WHEN '4-NOT SPECIFIED' THEN '2' ELSE '3+' END AS Dependents,
 CASE WHEN c.c_mktsegment IN ('BUILDING','FURNITURE') THEN 'Not Graduate' ELSE 'Graduate' END AS Education,
 CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'Yes' ELSE 'No' END AS Self_Employed,
 CASE WHEN c.c_nationkey < 10 THEN 'Urban' WHEN c.c_nationkey < 19 THEN 'Semiurban' ELSE 'Rural' END AS Property_Area,
 CAST(300 + (o.o_custkey * 131) % 650 AS BIGINT) AS mobile_usage_score,
 CAST(300 + (o.o_orderkey * 211) % 650 AS BIGINT) AS transaction_stability_score,
 CAST((o.o_custkey * 5381 + o.o_orderkey) % 800000 AS BIGINT) AS bank_balance
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

FEATURES = """
WITH f AS (
  SELECT *,
   COALESCE(ApplicantIncome, 0) + COALESCE(CoapplicantIncome, 0) AS total_income,
   CAST(LoanAmount AS DOUBLE) / (CASE WHEN COALESCE(Loan_Amount_Term, 0) = 0 THEN 1 ELSE Loan_Amount_Term END) AS emi,
   COALESCE(Credit_History, 0) AS ch
  FROM applications a)
SELECT *,
   CAST(total_income AS DOUBLE) / (emi + 1) AS income_to_emi_ratio,
   CAST(LoanAmount AS DOUBLE) / (bank_balance + 50000) AS credit_utilization,
   0.4e0 * (transaction_stability_score / 950e0) + 0.3e0 * (mobile_usage_score / 950e0) + 0.3e0 * ch AS stability_score
FROM f
"""

RISK_FULL = """
WITH g AS (SELECT * FROM features),
s AS (SELECT MAX(total_income) AS max_income, quantile_cont(income_to_emi_ratio, 0.9) AS q_ratio,
             quantile_cont(bank_balance, 0.9) AS q_bal FROM g),
c AS (
  SELECT g.*, max_income, q_ratio, q_bal,
   (0.35e0 * transaction_stability_score + 0.25e0 * mobile_usage_score
    + 0.2e0 * (CAST(total_income AS DOUBLE) / max_income * 900) + 0.2e0 * (ch * 900)) / 2 AS cibil_proxy_score
  FROM g CROSS JOIN s),
r AS (
  SELECT *, 0.3e0 * (cibil_proxy_score / 900) + 0.25e0 * (income_to_emi_ratio / (q_ratio + 1)) + 0.2e0 * ch
   + 0.15e0 * (bank_balance / (q_bal + 1)) - 0.1e0 * credit_utilization AS risk_score
  FROM c),
p AS (SELECT r.*, mn, mx, (risk_score - mn) / (mx - mn + 1e-6) AS probability
  FROM r CROSS JOIN (SELECT MIN(risk_score) AS mn, MAX(risk_score) AS mx FROM r) z)
SELECT *,
 CASE WHEN probability >= 0.5e0 THEN 'approved' ELSE 'denied' END AS decision,
 CASE WHEN ((application_id * 7919 + 104729) % 10007) / 10007e0 < GREATEST(0.05e0, LEAST(0.95e0, probability)) THEN 1 ELSE 0 END AS Approved
FROM p
"""

RISK = """
SELECT application_id, applicant_id, submitted_at, Gender, Credit_History, Property_Area, LoanAmount, bank_balance,
 total_income, emi, income_to_emi_ratio, credit_utilization, stability_score, cibil_proxy_score,
 mobile_usage_score, transaction_stability_score, probability, decision, Approved
FROM risk_full
"""

REQUESTS = """
SELECT *, TIMESTAMP '2024-01-01 00:00:00' + CAST((application_id * 7919) % 43200 AS INT) * INTERVAL 1 MINUTE AS requested_at FROM risk_full
"""

CONSENT_EVENTS = """
SELECT event_id, ts, user_id AS applicant_id,
 CASE event_type WHEN 'click' THEN 'Financial Data' WHEN 'view' THEN 'Credit History Data' WHEN 'signup' THEN 'Demographic Data'
  WHEN 'error' THEN 'Behaviour / Digital Data' ELSE 'Banking Behaviour Data' END AS group_name,
 TRY_CAST(json_extract_string(props, '$.k') AS INT) % 3 <> 0 AS allowed
FROM events
"""

GOVERNANCE_EVENTS = """
SELECT user_id AS chain_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
 CASE event_type WHEN 'click' THEN 'decision' WHEN 'view' THEN 'model-update' WHEN 'signup' THEN 'override'
  WHEN 'error' THEN 'bias-alert' ELSE 'consent-change' END AS event_type,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'indian_v1' END AS model_version, props AS details
FROM events
"""

QUESTIONS = """
SELECT c_custkey AS question_id, c_custkey AS applicant_id,
 CAST(DATE '1992-06-01' + CAST(c_custkey * 37 % 2200 AS INT) AS TIMESTAMP) AS asked_at,
 CONCAT(CASE c_custkey % 8 WHEN 0 THEN 'What bank balance do I need' WHEN 1 THEN 'What salary is needed'
  WHEN 2 THEN 'What EMI ratio is healthy' WHEN 3 THEN 'Which CIBIL score is enough' WHEN 4 THEN 'How does mobile usage matter for credit'
  WHEN 5 THEN 'What credit utilisation is fine' WHEN 6 THEN 'Tell me a joke' ELSE 'How can I get approved' END,
  CASE WHEN c_custkey % 3 = 0 THEN '?' ELSE CONCAT(' for a loan of ', CAST((c_custkey % 20 + 1) * 100000 AS VARCHAR), '?') END) AS question
FROM customer
"""

# name -> (sql, dependencies)
VIEWS = {
    "applications": (APPLICATIONS, []),
    "features": (FEATURES, ["applications"]),
    "risk_full": (RISK_FULL, ["features"]),
    "risk": (RISK, ["risk_full"]),
    "requests": (REQUESTS, ["risk_full"]),
    "consent_events": (CONSENT_EVENTS, []),
    "governance_events": (GOVERNANCE_EVENTS, []),
    "questions": (QUESTIONS, []),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with CTEs for the named views and their dependencies."""
    order: list[str] = []

    def visit(n: str):
        for d in VIEWS[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][0].strip()})" for n in order)
    body = body.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
