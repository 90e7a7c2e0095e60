"""Fairness queries: selection rates, disparate impact, bias alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as HS
from ..operators import audit as AU
from ..operators import fairness as FA
from ..operators.audit import ALERT_LINK_KEYS
from .common import round_doubles, views
from .registry import register

# Attributes audited by default on the decision table.
AUDITED = ["Gender", "Credit_History", "Property_Area"]


def _rates(spark, sf_dir):
    risk = views(spark, sf_dir).risk
    pred = risk.select(*AUDITED, (F.col("decision") == "approved").cast("int").alias("y_pred"))
    return FA.selection_rates(pred, AUDITED, "y_pred")


_RATES_SQL = """
WITH s AS (
  SELECT 'Gender' AS sensitive_feature, COALESCE(CAST(Gender AS VARCHAR), 'nan') AS group_value,
         CASE WHEN decision = 'approved' THEN 1 ELSE 0 END AS y FROM risk
  UNION ALL
  SELECT 'Credit_History', COALESCE(CAST(Credit_History AS VARCHAR), 'nan'),
         CASE WHEN decision = 'approved' THEN 1 ELSE 0 END FROM risk
  UNION ALL
  SELECT 'Property_Area', COALESCE(CAST(Property_Area AS VARCHAR), 'nan'),
         CASE WHEN decision = 'approved' THEN 1 ELSE 0 END FROM risk),
g AS (SELECT sensitive_feature, group_value, COUNT(*) AS n_rows, SUM(y) AS sy FROM s GROUP BY 1, 2),
t AS (SELECT sensitive_feature, SUM(sy) * 1.0e0 / SUM(n_rows) AS overall FROM g GROUP BY 1),
rates AS (SELECT g.sensitive_feature, group_value, CAST(n_rows AS BIGINT) AS n_rows,
                 CAST(sy AS DOUBLE) / n_rows AS selection_rate, overall AS overall_selection_rate
          FROM g JOIN t ON g.sensitive_feature = t.sensitive_feature),
disp AS (SELECT sensitive_feature, CAST(COUNT(*) AS BIGINT) AS n_groups, MIN(selection_rate) AS min_rate,
                MAX(selection_rate) AS max_rate,
                CASE WHEN MAX(selection_rate) > 0 THEN MIN(selection_rate) / MAX(selection_rate) END AS disparate_impact,
                CASE WHEN MAX(selection_rate) > 0 THEN MAX(selection_rate) - MIN(selection_rate) END AS statistical_parity_difference
         FROM rates GROUP BY 1)
"""


@register("fairness_by_group", oracle=_RATES_SQL + """
SELECT sensitive_feature, group_value, n_rows, ROUND(selection_rate, 6) AS selection_rate,
       ROUND(overall_selection_rate, 6) AS overall_selection_rate FROM rates
""", views=("risk",))
def fairness_by_group(spark, sf_dir):
    return round_doubles(_rates(spark, sf_dir))


@register("disparate_impact", oracle=_RATES_SQL + """
SELECT sensitive_feature, n_groups, ROUND(min_rate, 6) AS min_rate, ROUND(max_rate, 6) AS max_rate,
       ROUND(disparate_impact, 6) AS disparate_impact,
       ROUND(statistical_parity_difference, 6) AS statistical_parity_difference FROM disp
""", views=("risk",))
def disparate_impact(spark, sf_dir):
    return round_doubles(FA.disparity(_rates(spark, sf_dir)))


@register("bias_alerts", oracle=_RATES_SQL + """
SELECT sensitive_feature, alert_order, metric, ROUND(value, 6) AS value, threshold FROM (
  SELECT sensitive_feature, 0 AS alert_order, 'disparate_impact' AS metric, disparate_impact AS value,
         0.8e0 AS threshold FROM disp WHERE disparate_impact < 0.8e0
  UNION ALL
  SELECT sensitive_feature, 1, 'statistical_parity_difference', statistical_parity_difference, 0.2e0
  FROM disp WHERE statistical_parity_difference > 0.2e0) x
""", views=("risk",))
def bias_alerts(spark, sf_dir):
    rates = _rates(spark, sf_dir)
    return round_doubles(FA.bias_alerts(FA.disparity(rates)))


def _json_num(e: str) -> str:
    return f"CAST(CAST({e} AS DECIMAL(18,6)) AS VARCHAR)"


@register("bias_alert_events", oracle=_RATES_SQL + f"""
, al AS (SELECT sensitive_feature, 0 AS o, 'disparate_impact' AS metric, disparate_impact AS value, 0.8e0 AS threshold
         FROM disp WHERE disparate_impact < 0.8e0
         UNION ALL SELECT sensitive_feature, 1, 'statistical_parity_difference', statistical_parity_difference, 0.2e0
         FROM disp WHERE statistical_parity_difference > 0.2e0),
det AS (SELECT sensitive_feature, '{{"alerts":[' || string_agg('{{"metric":"' || metric || '","value":' || {_json_num('value')}
          || ',"threshold":' || {_json_num('threshold')} || '}}', ',' ORDER BY o) || ']}}' AS details FROM al GROUP BY 1),
snap AS (SELECT sensitive_feature, '{{"available":true,"sensitive_feature":"' || sensitive_feature || '","overall_selection_rate":'
          || {_json_num('MAX(overall_selection_rate)')} || ',"by_group":{{' || string_agg('"' || group_value || '":' || {_json_num('selection_rate')}, ',' ORDER BY group_value)
          || '}}}}' AS fairness_snapshot FROM rates GROUP BY 1),
ev AS (SELECT det.sensitive_feature, 'bias-alert' AS event_type, fairness_snapshot, details,
         sha256(det.sensitive_feature || '|' || fairness_snapshot || '|' || details) AS event_key FROM det JOIN snap ON det.sensitive_feature = snap.sensitive_feature)
SELECT sensitive_feature, event_type, fairness_snapshot, details, event_key, CAST(1 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS previous_hash,
       sha256({HS.canonical_sql([(k, k) for k in ALERT_LINK_KEYS])} || '|previous_hash=null') AS output_hash FROM ev""", views=("risk",))
def bias_alert_events(spark, sf_dir):
    """Alert events with metric snapshots, hashed as links of the governance log (one chain per attribute)."""
    rates = _rates(spark, sf_dir)
    disp = FA.disparity(rates)
    return AU.append_alerts(FA.alert_snapshot(rates, disp, FA.bias_alerts(disp)))
