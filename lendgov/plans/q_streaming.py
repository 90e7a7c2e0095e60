"""Streaming queries (G1-G5): stage the derived input as files, run the stream to the end
of the available input, and return the sink as a DataFrame (rows-only check)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import consent as CO
from ..operators.prep import spread
from ..session import checkpoint_path
from ..sources import files as FS
from ..streaming import jobs as ST
from .common import round_doubles, views
from .q_audit import _GOV_CHAIN_SQL, _gov_payload, _gov_stored
from .q_consent import _ACCESS_SQL, SERVE_FEATURES, _served_with_flags, feature_group_map
from .registry import register


def _run_dir(spark, name):
    return checkpoint_path(spark, os.path.join("streams", f"{name}-{uuid.uuid4().hex[:12]}"))


def _decisions(v):
    r = v.risk
    return r.select(F.col("application_id").alias("id"), F.col("submitted_at").cast("timestamp").alias("ts"),
                    "decision", "probability", "Gender", F.col("Credit_History").cast("int").alias("Credit_History"), "Property_Area")


def _finish(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@register("stream_daily_volume", oracle="SELECT CAST(submitted_at AS DATE) AS day, CAST(COUNT(*) AS BIGINT) AS n FROM applications GROUP BY 1",
          views=("applications",))
def stream_daily_volume(spark, sf_dir):
    """G1. The stream ends with a sentinel row past the watermark so every day closes."""
    v = views(spark, sf_dir)
    d = _run_dir(spark, "daily_volume")
    src, sink = os.path.join(d, "src"), os.path.join(d, "sink")
    dec = _decisions(v)
    dec.write.parquet(os.path.join(src, "part=0"))
    last = dec.agg(F.max("ts").alias("m")).select(
        F.lit(-1).cast("long").alias("id"), (F.col("m") + F.expr("INTERVAL 3 DAYS")).alias("ts"),
        F.lit("sentinel").alias("decision"), F.lit(None).cast("double").alias("probability"),
        F.lit(None).cast("string").alias("Gender"), F.lit(None).cast("int").alias("Credit_History"),
        F.lit(None).cast("string").alias("Property_Area"))
    last.write.parquet(os.path.join(src, "part=1"))
    _finish(ST.daily_volume(spark, src, sink, os.path.basename(d)))
    return spark.read.parquet(sink)


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT time_bucket(INTERVAL 7 DAYS, CAST(submitted_at AS TIMESTAMP), TIMESTAMP '1970-01-01') AS w, '{a}' AS sensitive_feature, "
    f"COALESCE(CAST({a} AS VARCHAR), 'nan') AS g, CASE WHEN decision = 'approved' THEN 1.0e0 ELSE 0.0e0 END AS y FROM risk" for a in ST.BIAS_ATTRIBUTES)


@register("stream_bias_alerts", oracle=f"""
WITH pairs AS ({_PAIRS_SQL}),
rates AS (SELECT w, sensitive_feature, g, AVG(y) AS rate FROM pairs GROUP BY 1, 2, 3),
d AS (SELECT w, sensitive_feature, MIN(rate) AS low, MAX(rate) AS high FROM rates GROUP BY 1, 2),
m AS (SELECT w, sensitive_feature, 'disparate_impact' AS metric, low / high AS value, 0.8e0 AS threshold FROM d WHERE high > 0 AND low / high < 0.8e0
      UNION ALL SELECT w, sensitive_feature, 'statistical_parity_difference', high - low, 0.2e0 FROM d WHERE high > 0 AND high - low > 0.2e0)
SELECT CAST(w AS DATE) AS window_day, sensitive_feature, metric, ROUND(value, 9) AS value, threshold, 'bias-alert' AS event_type FROM m""",
          views=("risk",))
def stream_bias_alerts(spark, sf_dir):
    """The alerts that stand per 7-day window and attribute after the stream, whatever its micro-batches were."""
    v = views(spark, sf_dir)
    d = _run_dir(spark, "bias")
    src, sink = os.path.join(d, "src"), os.path.join(d, "sink")
    # several files and triggers: groups of a window come in different batches
    _decisions(v).repartition(8).write.parquet(src)
    _finish(ST.bias_monitor(spark, src, sink, os.path.basename(d), max_files=3))
    return round_doubles(ST.current_alerts(spark, sink).select(
        F.to_date("window_start").alias("window_day"), "sensitive_feature", "metric", "value", "threshold", "event_type"), 9)


@register("stream_consent_state", oracle="""
SELECT applicant_id, group_name, arg_max(allowed, (ts, event_id)) AS allowed, MAX(ts) AS updated_at
FROM consent_events GROUP BY 1, 2""", views=("consent_events",))
def stream_consent_state(spark, sf_dir):
    """Latest consent per (applicant, group) maintained by a stateful stream."""
    v = views(spark, sf_dir)
    d = _run_dir(spark, "consent")
    src, sink = os.path.join(d, "src"), os.path.join(d, "sink")
    v.consent_events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "applicant_id", "group_name",
                            "allowed").write.parquet(src)
    _finish(ST.consent_state(spark, src, sink, os.path.basename(d)))
    return ST.latest_consent_table(spark, sink).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@register("stream_governance_chain", oracle=_GOV_CHAIN_SQL + """
SELECT chain_id, seq, ts, previous_hash, output_hash FROM chain""", views=("governance_events",))
def stream_governance_chain(spark, sf_dir):
    """Hash-chain links written by a stateful stream in event-time order."""
    v = views(spark, sf_dir)
    d = _run_dir(spark, "chain")
    src, sink = os.path.join(d, "src"), os.path.join(d, "sink")
    e = _gov_stored(v).withColumn("payload", _gov_payload())
    ST.write_event_files(e.select(F.col("chain_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("rank"), F.col("event_id").alias("id"),
                                  F.to_json(F.struct("payload")).alias("body")), src)
    _finish(ST.governance_chain(spark, src, sink, os.path.basename(d)))
    return spark.read.parquet(sink).select(F.col("key").alias("chain_id"), "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "previous_hash", "output_hash")


@register("stream_access_log", oracle=_ACCESS_SQL + """
SELECT feature, allowed, model_version, CAST(ts AS TIMESTAMP) AS ts FROM log""", views=("applications", "consent_events"))
def stream_access_log(spark, sf_dir):
    """Access-log JSON lines (written by the S9 sink) ingested by a file stream."""
    d = _run_dir(spark, "access")
    src, sink = os.path.join(d, "src"), os.path.join(d, "sink")
    df = spread(_served_with_flags(views(spark, sf_dir)))  # a compressed file is read by one task: many small ones
    log = CO.access_records(df, feature_group_map(), SERVE_FEATURES, ts="submitted_at")
    FS.write_access_log(log, src)
    _finish(ST.access_log_ingest(spark, src, sink, os.path.basename(d)))
    return ST.accepted(spark, sink).select("feature", "allowed", "model_version", F.col("ts").cast("timestamp_ntz").alias("ts"))


# What a line of the log became on its way, by application: some are cut off, some hold no object, a wrong type, no feature, or nothing.
_LINE_KINDS = {0: "rejected|not JSON", 1: "blank|", 2: "rejected|not an object", 3: "rejected|allowed is not boolean", 4: "rejected|no feature"}
_LINE_EXPR = ("CASE CAST(application_id % 29 AS INT) WHEN 0 THEN substr(value, 1, 30) WHEN 1 THEN '   ' WHEN 2 THEN concat('[', value, ']') "
              "WHEN 3 THEN replace(replace(value, ':true', ':\"yes\"'), ':false', ':\"no\"') WHEN 4 THEN replace(value, '\"feature\"', '\"feat\"') ELSE value END")


@register("stream_access_log_judged", oracle=_ACCESS_SQL + """,
k AS (SELECT CASE application_id % 29 """ + " ".join(f"WHEN {i} THEN '{t}'" for i, t in _LINE_KINDS.items()) + """ ELSE 'accepted|' END AS kind FROM log)
SELECT split_part(kind, '|', 1) AS status, NULLIF(split_part(kind, '|', 2), '') AS reason, CAST(COUNT(*) AS BIGINT) AS lines FROM k GROUP BY 1, 2""",
          views=("applications", "consent_events"))
def stream_access_log_judged(spark, sf_dir):
    """G5 + S10 over a log with malformed lines: how many lines were taken, blank, or rejected and why; together they are all lines."""
    d = _run_dir(spark, "judged")
    src, sink = os.path.join(d, "src"), os.path.join(d, "sink")
    log = CO.access_records(spread(_served_with_flags(views(spark, sf_dir))), feature_group_map(), SERVE_FEATURES, ts="submitted_at")
    lines = log.select("application_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "feature", "allowed", "model_version")).alias("value"))
    FS.write_log_lines(lines.select(F.expr(_LINE_EXPR).alias("value")), src)
    _finish(ST.access_log_ingest(spark, src, sink, os.path.basename(d)))
    return spark.read.parquet(sink).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("lines"))
