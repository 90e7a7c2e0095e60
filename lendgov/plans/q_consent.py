"""Consent queries (S7-S9, J1-J3, J6, P15, P16, W7, W9, U1, X11) and the scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FX
from ..operators import consent as CO
from ..operators import scoring as SC
from ..sources.derived import APPLICATION_COLUMNS, RAW_FEATURES
from .common import round_doubles, views
from .registry import register

# Groups with columns in the loan dataset (the Banking group has none, so it drops out).
KNOWN_GROUPS = CO.known_groups(APPLICATION_COLUMNS)
SERVE_FEATURES = FX.MODEL_FEATURES


def feature_group_map(columns=APPLICATION_COLUMNS) -> dict[str, str]:
    """The dataset's own feature -> group map."""
    return CO.group_map(columns)


FEATURE_GROUP = feature_group_map()  # of the declared schema, for the SQL texts below


def _applicants(v):
    return v.applications.select("applicant_id").distinct()


def _state(v):
    return CO.consent_state(_applicants(v), v.consent_events, KNOWN_GROUPS)


def _served_with_flags(v):
    apps = v.applications
    served = FX.with_serve_features(apps).select("application_id", "applicant_id", "submitted_at",
                                                 *SERVE_FEATURES)
    return CO.with_flags(served, v.consent_events, KNOWN_GROUPS)


# ---- oracle building blocks -------------------------------------------------
_GROUPS_SQL = ", ".join(f"('{g}')" for g in KNOWN_GROUPS)
_STATE_SQL = f"""
latest AS (SELECT applicant_id, group_name, arg_max(allowed, (ts, event_id)) AS allowed
           FROM consent_events GROUP BY 1, 2),
grid AS (SELECT DISTINCT a.applicant_id, g.group_name FROM applications a CROSS JOIN (VALUES {_GROUPS_SQL}) g(group_name)),
state AS (SELECT grid.applicant_id, grid.group_name, COALESCE(latest.allowed, TRUE) AS allowed,
                 latest.allowed IS NULL AS is_default
          FROM grid LEFT JOIN latest ON grid.applicant_id = latest.applicant_id AND grid.group_name = latest.group_name),
flags AS (SELECT applicant_id,
  bool_and(allowed) FILTER (WHERE group_name = 'Financial Data') AS ok_fin,
  bool_and(allowed) FILTER (WHERE group_name = 'Credit History Data') AS ok_ch,
  bool_and(allowed) FILTER (WHERE group_name = 'Demographic Data') AS ok_dem,
  bool_and(allowed) FILTER (WHERE group_name = 'Behaviour / Digital Data') AS ok_beh
  FROM state GROUP BY 1)"""

_GROUP_FLAG_SQL = {"Financial Data": "ok_fin", "Credit History Data": "ok_ch",
                   "Demographic Data": "ok_dem", "Behaviour / Digital Data": "ok_beh"}

_SERVE_SQL = """
served AS (
  SELECT a.*, z.total_income, z.emi,
   CASE WHEN z.total_income = 0 THEN 0.0e0 ELSE z.total_income / (z.emi + 1) END AS income_to_emi_ratio,
   z.util AS credit_utilization,
   0.4e0 * (z.txn / 950) + 0.3e0 * (z.mob / 950) + 0.3e0 * z.ch AS stability_score,
   (0.35e0 * z.txn + 0.25e0 * z.mob + 0.2e0 * z.total_income + 0.2e0 * (z.ch * 900)) / 2 AS cibil_proxy_score
  FROM applications a JOIN (
   SELECT application_id,
    COALESCE(CAST(ApplicantIncome AS DOUBLE), 0) + COALESCE(CAST(CoapplicantIncome AS DOUBLE), 0) AS total_income,
    COALESCE(CAST(LoanAmount AS DOUBLE), 0) / (CASE WHEN COALESCE(CAST(Loan_Amount_Term AS DOUBLE), 0) = 0 THEN 1.0e0
         ELSE CAST(Loan_Amount_Term AS DOUBLE) END) AS emi,
    COALESCE(CAST(LoanAmount AS DOUBLE), 0) / (COALESCE(CAST(bank_balance AS DOUBLE), 0) + 50000) AS util,
    COALESCE(CAST(Credit_History AS DOUBLE), 0) AS ch,
    COALESCE(CAST(transaction_stability_score AS DOUBLE), 0) AS txn,
    COALESCE(CAST(mobile_usage_score AS DOUBLE), 0) AS mob
   FROM applications) z ON a.application_id = z.application_id)"""


def _masked_select(mode: str) -> str:
    out = []
    for f in SERVE_FEATURES:
        g = FEATURE_GROUP.get(f)
        dbl = f in FX.NUMERIC_FEATURES and f not in ("ApplicantIncome", "CoapplicantIncome", "LoanAmount",
                                                     "Loan_Amount_Term", "mobile_usage_score",
                                                     "transaction_stability_score", "bank_balance")
        val = f"ROUND({f}, 6)" if dbl else f
        if g is None:
            out.append(f"{val} AS {f}")
            continue
        flag = _GROUP_FLAG_SQL[g]
        if mode == "drop":
            out.append(f"CASE WHEN {flag} THEN {val} END AS {f}")
        else:
            if f == "Credit_History" or f in FX.NUMERIC_FEATURES:
                repl = "0"
            else:
                repl = "'missing'"
            out.append(f"CASE WHEN {flag} THEN {val} ELSE {repl} END AS {f}")
    return ", ".join(out)


_DIM_VALUES = ", ".join([f"('{g}', {gi}, '{c}', {fi}, false)" for gi, (g, cols) in enumerate(CO.GROUP_CANDIDATES) for fi, c in enumerate(cols)]
                        + [f"('{g}', {CO.ALL_GROUPS.index(g)}, '{c}', {100 + fj}, true)" for g, fs in CO.GROUP_ENGINEERED.items() for fj, c in enumerate(fs)])
_DIM_FEATURES = [f for f in FEATURE_GROUP]


@register("feature_group_dim", oracle=f"""
WITH cand(group_name, group_order, feature, feature_order, engineered) AS (VALUES {_DIM_VALUES}),
vals AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, COUNT({c}) AS n_values, COUNT(*) AS n_rows FROM risk_full" for c in _DIM_FEATURES)}),
kept AS (SELECT * FROM cand WHERE feature IN (SELECT feature FROM vals))
SELECT group_name, group_order, x.feature, feature_order, CAST(n_values AS BIGINT) AS n_values, CAST(n_rows AS BIGINT) AS n_rows FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY group_order) AS rn FROM kept) x JOIN vals ON x.feature = vals.feature WHERE rn = 1
""", views=("risk_full",))
def feature_group_dim(spark, sf_dir):
    """J1 + J3: the dataset's features by consent group, with how many rows hold a value a consent covers."""
    v = views(spark, sf_dir)
    counts = v.scored.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in _DIM_FEATURES])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_values"), F.col("_n").alias("n_rows"))
                                             for c in _DIM_FEATURES])).alias("r")).select("r.*")
    return CO.feature_groups(v.applications).join(long, "feature").select(
        "group_name", "group_order", "feature", "feature_order", "n_values", "n_rows")


@register("consent_state", oracle=f"WITH {_STATE_SQL} SELECT applicant_id, group_name, allowed, is_default FROM state",
          views=("applications", "consent_events"))
def consent_state(spark, sf_dir):
    return _state(views(spark, sf_dir))


@register("consent_latest", oracle="""
SELECT applicant_id, group_name, arg_max(allowed, (ts, event_id)) AS allowed, MAX(ts) AS updated_at
FROM consent_events GROUP BY 1, 2""", views=("consent_events",))
def consent_latest(spark, sf_dir):
    return CO.latest_consent(views(spark, sf_dir).consent_events)


@register("consent_masked", oracle=f"""
WITH {_STATE_SQL}, {_SERVE_SQL.strip()}
SELECT application_id, served.applicant_id, {_masked_select("drop")}
FROM served LEFT JOIN flags ON served.applicant_id = flags.applicant_id""",
          views=("applications", "consent_events"))
def consent_masked(spark, sf_dir):
    v = views(spark, sf_dir)
    out = CO.mask_drop(_served_with_flags(v), feature_group_map(v.applications.columns), SERVE_FEATURES).drop("submitted_at")
    return round_doubles(out)


@register("consent_neutral_masked", oracle=f"""
WITH {_STATE_SQL}, {_SERVE_SQL.strip()}
SELECT application_id, served.applicant_id, {_masked_select("neutral")}
FROM served LEFT JOIN flags ON served.applicant_id = flags.applicant_id""",
          views=("applications", "consent_events"))
def consent_neutral_masked(spark, sf_dir):
    v = views(spark, sf_dir)
    df = _served_with_flags(v)
    numeric = FX.NUMERIC_FEATURES + ["Credit_History"]
    categorical = [c for c in FX.CATEGORICAL_FEATURES if c != "Credit_History"]
    out = CO.mask_neutral(df, feature_group_map(v.applications.columns), numeric, categorical).drop("submitted_at")
    return round_doubles(out)


def _access_log(spark, sf_dir):
    v = views(spark, sf_dir)
    return CO.access_records(_served_with_flags(v), feature_group_map(v.applications.columns), SERVE_FEATURES, ts="submitted_at")


def _access_sql():
    recs = []
    for i, f in enumerate(SERVE_FEATURES):
        g = FEATURE_GROUP.get(f)
        ok = f"COALESCE({_GROUP_FLAG_SQL[g]}, TRUE)" if g else "TRUE"
        recs.append(f"({i}, '{f}', {ok})")
    return f"""
{_STATE_SQL},
acc AS (
  SELECT a.application_id, a.applicant_id, a.submitted_at AS ts, r.feature_order, r.feature, r.allowed, 'indian_v1' AS model_version
  FROM applications a LEFT JOIN flags ON a.applicant_id = flags.applicant_id,
  LATERAL (SELECT * FROM (VALUES {", ".join(recs)}) v(feature_order, feature, allowed)) r)"""


_ACCESS_SQL = f"WITH {_access_sql()}, log AS (SELECT * FROM acc)"


@register("access_log", oracle=f"WITH {_access_sql()} SELECT * FROM acc", views=("applications", "consent_events"))
def access_log(spark, sf_dir):
    return _access_log(spark, sf_dir)


@register("recent_access", oracle=f"""
WITH {_access_sql()} SELECT * FROM acc ORDER BY ts DESC, application_id DESC, feature_order DESC LIMIT 100""",
          views=("applications", "consent_events"))
def recent_access(spark, sf_dir):
    return CO.recent_access(_access_log(spark, sf_dir), 100)


@register("access_log_local", oracle=f"""
WITH {_access_sql()}
SELECT applicant_id, MAX(ts) AS last_access_utc,
       strftime(MAX(ts) + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') || ' IST' AS last_access_local
FROM acc GROUP BY 1""", views=("applications", "consent_events"))
def access_log_local(spark, sf_dir):
    return CO.last_access_local(_access_log(spark, sf_dir))


@register("consent_changes", oracle="""
SELECT applicant_id, group_name, event_id, ts, CASE WHEN allowed THEN 'enabled' ELSE 'disabled' END AS change
FROM (SELECT *, LAG(allowed, 1, TRUE) OVER (PARTITION BY applicant_id, group_name ORDER BY ts, event_id) AS prev
      FROM consent_events) x WHERE allowed <> prev""", views=("consent_events",))
def consent_changes(spark, sf_dir):
    return CO.consent_changes(views(spark, sf_dir).consent_events)


def _profile_sql():
    fields = RAW_FEATURES
    struct = ", ".join(f"'{f}': {f}" for f in fields)
    sel = []
    for f in fields:
        d = CO.PROFILE_DEFAULTS[f]
        lit = f"'{d}'" if isinstance(d, str) else str(d)
        sel.append(f"CASE WHEN p IS NOT NULL THEN p.{f} ELSE {lit} END AS {f}")
    return f"""
WITH latest AS (SELECT applicant_id, arg_max({{{struct}}}, (submitted_at, application_id)) AS p
                FROM applications GROUP BY 1)
SELECT c.c_custkey AS applicant_id, p IS NOT NULL AS has_profile, {", ".join(sel)}
FROM customer c LEFT JOIN latest ON c.c_custkey = latest.applicant_id"""


@register("profile_with_defaults", oracle=_profile_sql(), views=("applications",))
def profile_with_defaults(spark, sf_dir):
    v = views(spark, sf_dir)
    applicants = v.t.customer.select(F.col("c_custkey").alias("applicant_id"))
    return CO.profiles(applicants, v.applications, RAW_FEATURES)


_SCORE_INPUTS = ["application_id", "Credit_History", "stability_score", "cibil_proxy_score",
                 "income_to_emi_ratio", "credit_utilization", "bank_balance"]


@register("scorecard", oracle="""
SELECT application_id, ROUND(1e0 / (1e0 + EXP(-(-2.0e0 + 1.5e0 * COALESCE(Credit_History, 1) + 1.0e0 * stability_score
  + 0.004e0 * cibil_proxy_score + 0.01e0 * LEAST(income_to_emi_ratio, 50e0) - 0.05e0 * LEAST(credit_utilization, 20e0)
  + 0.000001e0 * bank_balance))), 6) AS p_approve FROM risk""", views=("risk",))
def scorecard(spark, sf_dir):
    v = views(spark, sf_dir)
    r = v.risk.select(*_SCORE_INPUTS)
    return round_doubles(SC.score(r, v.scorecard_params).select("application_id", "p_approve"))


def _whatif_sql():
    def z(masked: bool) -> str:
        terms = []
        for c, w, cap in SC.TERMS:
            g = FEATURE_GROUP.get(c)
            v = f"CAST({c} AS DOUBLE)"
            if masked and g:
                v = f"CASE WHEN COALESCE({_GROUP_FLAG_SQL[g]}, TRUE) THEN {v} END"
            v = f"COALESCE({v}, med_{c})"
            if cap is not None:
                v = f"LEAST({v}, CAST({cap!r} AS DOUBLE))"
            terms.append(f"CAST({w!r} AS DOUBLE) * {v}")
        return "-2.0e0 + " + " + ".join(terms)
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c, _, _ in SC.TERMS)
    return f"""
WITH {_STATE_SQL},
m AS (SELECT {meds} FROM risk),
s AS (SELECT r.application_id, 1e0 / (1e0 + EXP(-({z(False)}))) AS p_baseline,
             1e0 / (1e0 + EXP(-({z(True)}))) AS p_consent
      FROM risk r CROSS JOIN m LEFT JOIN flags ON r.applicant_id = flags.applicant_id)
SELECT application_id, ROUND(p_baseline, 6) AS p_baseline, ROUND(p_consent, 6) AS p_consent,
       ROUND(p_consent - p_baseline, 6) AS delta,
       CASE WHEN p_baseline >= 0.5e0 THEN 'approved' ELSE 'denied' END AS decision_baseline,
       CASE WHEN p_consent >= 0.5e0 THEN 'approved' ELSE 'denied' END AS decision_consent
FROM s"""


@register("consent_whatif", oracle=_whatif_sql(), views=("risk", "applications", "consent_events"))
def consent_whatif(spark, sf_dir):
    v = views(spark, sf_dir)
    r = v.risk.select(*_SCORE_INPUTS, "applicant_id")
    meds = v.scorecard_params
    flagged = CO.with_flags(r, v.consent_events, KNOWN_GROUPS)
    groups = feature_group_map(v.applications.columns)
    allowed = {c: CO.flag_col(groups[c]) for c, _, _ in SC.TERMS if c in groups}
    base = SC.score(flagged, meds).withColumnRenamed("p_approve", "p_baseline")
    both = SC.score(base, meds, allowed).withColumnRenamed("p_approve", "p_consent")
    out = both.select("application_id", "p_baseline", "p_consent",
                      (F.col("p_consent") - F.col("p_baseline")).alias("delta"),
                      FX.decision_label("p_baseline").alias("decision_baseline"),
                      FX.decision_label("p_consent").alias("decision_consent"))
    return round_doubles(out)
