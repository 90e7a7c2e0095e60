"""Dashboard queries over the decision table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as MO
from .common import round_doubles, views
from .registry import register

MODEL_VERSION = "indian_v1"


def decisions(spark, sf_dir):
    """Decision log view: one row per scored application."""
    r = views(spark, sf_dir).risk
    return r.select(F.col("application_id").alias("id"), F.col("submitted_at").alias("ts"),
                    "decision", "probability", F.lit(MODEL_VERSION).alias("model_version"))


_DEC = """decisions AS (SELECT application_id AS id, submitted_at AS ts, decision, probability,
                     'indian_v1' AS model_version FROM risk)"""

_SUMMARY = """
SELECT CAST(COUNT(*) AS BIGINT) AS total,
       CAST(COUNT(*) FILTER (WHERE decision = 'approved') AS BIGINT) AS approvals,
       CAST(COUNT(*) FILTER (WHERE decision = 'denied') AS BIGINT) AS denials,
       CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE decision = 'approved') * 100.0e0 / COUNT(*) ELSE 0.0e0 END AS approval_rate,
       CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE decision = 'denied') * 100.0e0 / COUNT(*) ELSE 0.0e0 END AS denial_rate
FROM decisions"""

_VOLUME = """
SELECT CAST(ts AS DATE) AS day, CAST(COUNT(*) AS BIGINT) AS n FROM decisions
WHERE ts >= (SELECT MAX(ts) FROM decisions) - INTERVAL 7 DAY GROUP BY 1"""

_ISO = """CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
          ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"""

_RECENT = f"""
SELECT id, {_ISO} AS timestamp, decision, COALESCE(probability, 0.0e0) AS probability, model_version,
       CASE WHEN decision = 'approved' THEN '✅ Approved' ELSE '❌ Denied' END AS outcome,
       printf('%.2f', COALESCE(probability, 0.0e0)) AS score_text, strftime(ts, '%H:%M') AS time_text
FROM decisions ORDER BY ts DESC, id DESC LIMIT 10"""

_RISK = """
SELECT bucket_order, CASE bucket_order WHEN 0 THEN 'Low Risk (High Prob)' WHEN 1 THEN 'Medium Risk'
       ELSE 'High Risk (Low Prob)' END AS category, CAST(COUNT(*) AS BIGINT) AS n
FROM (SELECT CASE WHEN probability IS NULL THEN 2 WHEN isnan(probability) THEN 2 WHEN probability >= 0.7e0 THEN 0
                  WHEN probability >= 0.3e0 THEN 1 ELSE 2 END AS bucket_order FROM decisions) b
GROUP BY 1"""


@register("decision_summary", oracle=f"WITH {_DEC} SELECT total, approvals, denials, ROUND(approval_rate, 6) AS approval_rate, ROUND(denial_rate, 6) AS denial_rate FROM ({_SUMMARY}) s",
          views=("risk",))
def decision_summary(spark, sf_dir):
    return round_doubles(MO.summary(decisions(spark, sf_dir)))


@register("daily_volume", oracle=f"WITH {_DEC} {_VOLUME}", views=("risk",))
def daily_volume(spark, sf_dir):
    return MO.daily_volume(decisions(spark, sf_dir), days=7)


@register("recent_decisions", oracle=f"WITH {_DEC} SELECT id, timestamp, decision, ROUND(probability, 6) AS probability, model_version, outcome, score_text, time_text FROM ({_RECENT}) r",
          views=("risk",))
def recent_decisions(spark, sf_dir):
    return round_doubles(MO.recent(decisions(spark, sf_dir), limit=10))


@register("risk_distribution", oracle=f"WITH {_DEC} {_RISK}", views=("risk",))
def risk_distribution(spark, sf_dir):
    return MO.risk_distribution(decisions(spark, sf_dir))


@register("dashboard_report", oracle=f"""
WITH {_DEC}, s AS ({_SUMMARY}), v AS ({_VOLUME}), r AS ({_RECENT}), k AS ({_RISK})
SELECT 'summary' AS section, 'total' AS item, CAST(NULL AS VARCHAR) AS label, total AS n, CAST(NULL AS DOUBLE) AS value FROM s
UNION ALL SELECT 'summary', 'approvals', NULL, approvals, NULL FROM s
UNION ALL SELECT 'summary', 'denials', NULL, denials, NULL FROM s
UNION ALL SELECT 'summary', 'approval_rate', NULL, NULL, ROUND(approval_rate, 6) FROM s
UNION ALL SELECT 'summary', 'denial_rate', NULL, NULL, ROUND(denial_rate, 6) FROM s
UNION ALL SELECT 'volume', CAST(day AS VARCHAR), NULL, n, NULL FROM v
UNION ALL SELECT 'recent', CAST(id AS VARCHAR), decision, NULL, ROUND(probability, 6) FROM r
UNION ALL SELECT 'risk', category, NULL, n, NULL FROM k
""", views=("risk",))
def dashboard_report(spark, sf_dir):
    return round_doubles(MO.dashboard(decisions(spark, sf_dir)))
