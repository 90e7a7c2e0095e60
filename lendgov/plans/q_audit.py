"""Audit-chain queries."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from ..functions import hashing as HS
from ..operators import audit as AU
from ..operators import consent as CO
from ..operators import scoring as SC
from ..sources.derived import RAW_FEATURES
from .common import views
from .q_consent import KNOWN_GROUPS, _GROUP_FLAG_SQL, _STATE_SQL
from .q_explain import _attr_sql
from .q_explain import _INPUTS as SC_INPUTS
from .registry import register

MODEL_VERSION = "indian_v1"
INPUT_KEYS = sorted(RAW_FEATURES)
GOV_KEYS = ["details", "event_type", "fairness_snapshot", "input_features", "model_version", "output_decision"]


def _input_hash_col():
    return HS.sha256(HS.canonical([(k, F.col(k)) for k in INPUT_KEYS]))


def _decision_payload(input_hash=None):
    return HS.canonical([("decision", F.col("decision")), ("input_hash", F.col("input_hash") if input_hash is None else input_hash),
                         ("probability", HS.prob_text(F.col("probability")))])


def _decision_links(v):
    """The stored decision log: folded once per input version, scanned by every reader."""
    def build():
        s = v.scored.select("application_id", "applicant_id", "submitted_at", "decision", "probability",
                            *RAW_FEATURES)
        s = s.select("application_id", "applicant_id", "submitted_at", "decision", "probability",
                     F.unhex(_input_hash_col()).alias("_hash"))
        text = F.lower(F.hex("_hash"))
        return AU.chain_links(s.withColumnRenamed("applicant_id", "chain_id"), "chain_id",
                              ["submitted_at", "application_id"], "payload",
                              ["application_id", "submitted_at", "input_hash", "decision", "probability"],
                              spelled={"input_hash": text, "payload": _decision_payload(text)})

    return v.stored("decision_log", build, [AU, HS, sys.modules[__name__]])


def _gov_stored(v):
    """Governance events as stored rows; ordered by (ts, event_id) within a chain by the fold."""
    g = v.governance_events_unsequenced
    return g.select("chain_id", "event_id", "ts", "event_type",
                    F.coalesce("model_version", F.lit("unknown")).alias("model_version"),
                    F.lit("{}").alias("input_features"), F.lit("{}").alias("output_decision"),
                    F.lit("{}").alias("fairness_snapshot"), F.coalesce("details", F.lit("{}")).alias("details"))


def _gov_payload():
    return HS.canonical([(k, F.col(k)) for k in GOV_KEYS])


def _gov_links(v):
    """The stored governance log."""
    def build():
        g = _gov_stored(v).withColumn("payload", _gov_payload())
        return AU.chain_links(g, "chain_id", ["ts", "event_id"], "payload",
                              ["ts", "event_type", "model_version", "input_features", "output_decision",
                               "fairness_snapshot", "details"])

    return v.stored("governance_log", build, [AU, HS, sys.modules[__name__]], tables=("events",))


# ---- oracle SQL --------------------------------------------------------------
_INPUT_SQL = HS.canonical_sql([(k, k) for k in INPUT_KEYS])
_DEC_PAYLOAD_SQL = HS.canonical_sql([("decision", "decision"), ("input_hash", "input_hash"),
                                     ("probability", HS.prob_text_sql("probability"))])
_GOV_PAYLOAD_SQL = HS.canonical_sql([(k, k) for k in GOV_KEYS])

_DEC_CHAIN_SQL = f"""
WITH RECURSIVE base AS (
  SELECT applicant_id AS chain_id, application_id, submitted_at, decision, probability, input_hash,
         ROW_NUMBER() OVER (PARTITION BY applicant_id ORDER BY submitted_at, application_id) AS seq,
         {_DEC_PAYLOAD_SQL} AS payload
  FROM (SELECT r.*, sha256({_INPUT_SQL}) AS input_hash FROM risk_full r) x),
chain AS (
  SELECT chain_id, seq, application_id, submitted_at, input_hash, decision, probability,
         CAST(NULL AS VARCHAR) AS previous_hash, sha256(payload || '|previous_hash=null') AS output_hash
  FROM base WHERE seq = 1
  UNION ALL
  SELECT b.chain_id, b.seq, b.application_id, b.submitted_at, b.input_hash, b.decision, b.probability,
         c.output_hash, sha256(b.payload || '|previous_hash=' || c.output_hash)
  FROM base b JOIN chain c ON b.chain_id = c.chain_id AND b.seq = c.seq + 1)"""

_GOV_CHAIN_SQL = f"""
WITH RECURSIVE stored AS (
  SELECT chain_id, seq, ts, event_type, COALESCE(model_version, 'unknown') AS model_version,
         '{{}}' AS input_features, '{{}}' AS output_decision, '{{}}' AS fairness_snapshot,
         COALESCE(details, '{{}}') AS details
  FROM governance_events),
base AS (SELECT *, {_GOV_PAYLOAD_SQL} AS payload FROM stored),
chain AS (
  SELECT chain_id, seq, ts, event_type, model_version, input_features, output_decision, fairness_snapshot, details,
         payload, CAST(NULL AS VARCHAR) AS previous_hash, sha256(payload || '|previous_hash=null') AS output_hash
  FROM base WHERE seq = 1
  UNION ALL
  SELECT b.chain_id, b.seq, b.ts, b.event_type, b.model_version, b.input_features, b.output_decision,
         b.fairness_snapshot, b.details, b.payload, c.output_hash,
         sha256(b.payload || '|previous_hash=' || c.output_hash)
  FROM base b JOIN chain c ON b.chain_id = c.chain_id AND b.seq = c.seq + 1)"""


@register("input_hash", oracle=f"SELECT application_id, sha256({_INPUT_SQL}) AS input_hash FROM applications",
          views=("applications",))
def input_hash(spark, sf_dir):
    return views(spark, sf_dir).applications.select("application_id", _input_hash_col().alias("input_hash"))


@register("decision_chain", oracle=_DEC_CHAIN_SQL + """
SELECT chain_id, seq, application_id, previous_hash, output_hash FROM chain""", views=("risk_full",))
def decision_chain(spark, sf_dir):
    return _decision_links(views(spark, sf_dir)).select("chain_id", "seq", "application_id", "previous_hash",
                                                        "output_hash")


def _consent_json_spark():
    parts = []
    for i, g in enumerate(sorted(KNOWN_GROUPS)):
        sep = "{" if i == 0 else ", "
        parts += [F.lit(f'{sep}"{g}": '),
                  F.when(F.col(CO.flag_col(g)), F.lit("true")).otherwise(F.lit("false"))]
    return F.concat(*parts, F.lit("}"))


def _consent_json_sql():
    parts = []
    for i, g in enumerate(sorted(KNOWN_GROUPS)):
        sep = "{" if i == 0 else ", "
        parts.append(f"'{sep}\"{g}\": ' || CASE WHEN COALESCE({_GROUP_FLAG_SQL[g]}, TRUE) THEN 'true' ELSE 'false' END")
    return " || ".join(parts) + " || '}'"


def _shap_json(attr):
    """The attributions as JSON text in feature order."""
    by_index = F.array_sort(F.transform(attr, lambda a: F.struct(a["feature_idx"], a["feature"], a["shap"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(by_index, lambda a: F.concat(
        F.lit('"'), a["feature"], F.lit('": '), HS.prob_text(a["shap"]))), ", "), F.lit("}"))


@register("audit_log", oracle=_DEC_CHAIN_SQL.replace("WITH RECURSIVE", f"WITH RECURSIVE {_STATE_SQL}, {_attr_sql()},", 1) + f""",
sj AS (SELECT application_id, '{{' || string_agg('"' || feature || '": ' || {HS.prob_text_sql("shap")}, ', ' ORDER BY feature_idx) || '}}' AS shap_values
       FROM attr GROUP BY 1)
SELECT chain.application_id AS id, submitted_at AS timestamp, input_hash, output_hash, previous_hash,
       {_consent_json_sql()} AS consent_state, 'indian_v1' AS model_version, decision,
       {HS.prob_text_sql("probability")} AS probability, sj.shap_values
FROM chain LEFT JOIN flags ON chain.chain_id = flags.applicant_id JOIN sj ON chain.application_id = sj.application_id""",
          views=("risk_full", "applications", "consent_events"))
def audit_log(spark, sf_dir):
    """S11 + H2: the decision log with consent state and the attributions of each decision."""
    v = views(spark, sf_dir)
    hashes = ["input_hash", "output_hash", "previous_hash"]
    links = _decision_links(v).select(F.col("chain_id").alias("applicant_id"), "application_id", "submitted_at", "decision", "probability",
                                      *[HS.short_hash(F.col(c)).alias(c) for c in hashes])
    # the flags are joined first, as they are narrow; hashes go through both joins as bytes, and the texts are written after them
    flagged = CO.with_flags(links, v.consent_events, KNOWN_GROUPS)
    shap = v.scored.select(F.col("application_id").alias("_id"), *SC_INPUTS)
    both = flagged.join(shap, F.col("application_id") == F.col("_id")).drop("_id")
    rows = SC.attribution_rows(both, [c for c in both.columns if c not in SC_INPUTS], fitted=v.scorecard_params)
    rows = rows.withColumn("shap_values", _shap_json(F.col("attr")))
    return rows.select(F.col("application_id").alias("id"), F.col("submitted_at").alias("timestamp"),
                       *[HS.long_hash(F.col(c)).alias(c) for c in hashes],
                       _consent_json_spark().alias("consent_state"),
                       F.lit(MODEL_VERSION).alias("model_version"), "decision",
                       HS.prob_text(F.col("probability")).alias("probability"), "shap_values")


@register("governance_chain", oracle=_GOV_CHAIN_SQL + """
SELECT chain_id, seq, ts, event_type, model_version, previous_hash, output_hash FROM chain""",
          views=("governance_events",))
def governance_chain(spark, sf_dir):
    return _gov_links(views(spark, sf_dir)).select("chain_id", "seq", "ts", "event_type", "model_version",
                                                   "previous_hash", "output_hash")


@register("governance_log", oracle=_GOV_CHAIN_SQL + """
SELECT chain_id, seq, ts AS timestamp, event_type, model_version, input_features, output_decision,
       fairness_snapshot, details, previous_hash, output_hash FROM chain""", views=("governance_events",))
def governance_log(spark, sf_dir):
    links = _gov_links(views(spark, sf_dir))
    return links.select("chain_id", "seq", F.col("ts").alias("timestamp"), "event_type", "model_version",
                        "input_features", "output_decision", "fairness_snapshot", "details",
                        "previous_hash", "output_hash")


def _verify_sql(log: str, payload: str) -> str:
    return f"""
chk AS (
  SELECT c.chain_id, c.seq,
         sha256({payload} || '|previous_hash=' || COALESCE(c.previous_hash, 'null')) = c.output_hash AS content_ok,
         CASE WHEN c.seq = f.first_seq THEN TRUE ELSE p.output_hash IS NOT NULL AND c.previous_hash IS NOT DISTINCT FROM p.output_hash END AS link_ok
  FROM {log} c LEFT JOIN {log} p ON c.chain_id = p.chain_id AND c.seq = p.seq + 1
  JOIN (SELECT chain_id, MIN(seq) AS first_seq FROM {log} GROUP BY 1) f ON c.chain_id = f.chain_id)
SELECT chain_id, CAST(COUNT(*) AS BIGINT) AS n_links,
       CAST(COUNT(*) FILTER (WHERE NOT content_ok) AS BIGINT) AS content_violations,
       CAST(COUNT(*) FILTER (WHERE NOT link_ok) AS BIGINT) AS link_violations,
       bool_and(content_ok AND link_ok) AS valid
FROM chk GROUP BY 1"""


_GOV_OF_C = HS.canonical_sql([(k, f"c.{k}") for k in GOV_KEYS])
_DEC_OF_C = HS.canonical_sql([("decision", "c.decision"), ("input_hash", "c.input_hash"), ("probability", HS.prob_text_sql("c.probability"))])


@register("chain_verify", oracle=_GOV_CHAIN_SQL + "," + _verify_sql("chain", _GOV_OF_C), views=("governance_events",))
def chain_verify(spark, sf_dir):
    """H5 over the stored governance log."""
    return AU.verify_summary(AU.verify(_gov_links(views(spark, sf_dir)), _gov_payload()))


@register("decision_chain_verify", oracle=_DEC_CHAIN_SQL + "," + _verify_sql("chain", _DEC_OF_C), views=("risk_full",))
def decision_chain_verify(spark, sf_dir):
    """H5 over the stored decision log."""
    return AU.verify_summary(AU.verify(_decision_links(views(spark, sf_dir)), _decision_payload()))


@register("chain_verify_tampered", oracle=_GOV_CHAIN_SQL + """,
bad AS (SELECT * REPLACE (CASE WHEN seq % 7 = 3 THEN details || ' ' ELSE details END AS details) FROM chain WHERE (chain_id + seq) % 11 <> 0),
""" + _verify_sql("bad", _GOV_OF_C), views=("governance_events",))
def chain_verify_tampered(spark, sf_dir):
    """H5 over a governance log that somebody edited (every 7th link's details) and deleted from (some links)."""
    log = _gov_links(views(spark, sf_dir)).where((F.col("chain_id") + F.col("seq")) % 11 != 0)
    edited = log.withColumn("details", F.when(F.col("seq") % 7 == 3, F.concat("details", F.lit(" "))).otherwise(F.col("details")))
    return AU.verify_summary(AU.verify(edited, _gov_payload()))


def _gov_json():
    return HS.sorted_json([(k, HS.json_string(F.col(k))) for k in GOV_KEYS])


_GOV_JSON_SQL = "'{' || " + " || ', ' || ".join(f"'\"{k}\": ' || COALESCE(CAST(to_json({k}) AS VARCHAR), 'null')" for k in sorted(GOV_KEYS))


@register("governance_chain_json", oracle=_GOV_CHAIN_SQL.replace(f"{_GOV_PAYLOAD_SQL} AS payload", f"{_GOV_JSON_SQL} AS payload")
          .replace("'|previous_hash=null'", "', \"previous_hash\": null}'").replace("'|previous_hash=' || c.output_hash", "', \"previous_hash\": \"' || c.output_hash || '\"}'")
          + " SELECT chain_id, seq, previous_hash, output_hash FROM chain", views=("governance_events",))
def governance_chain_json(spark, sf_dir):
    """H4 + X9: the governance chain hashed over sorted-key JSON payloads."""
    g = _gov_stored(views(spark, sf_dir)).withColumn("payload", _gov_json())
    return AU.chain_links(g, "chain_id", ["ts", "event_id"], "payload", ["ts"], link="json").select("chain_id", "seq", "previous_hash", "output_hash")


@register("chain_tips", oracle="""
WITH RECURSIVE x AS (SELECT 1) """ + _GOV_CHAIN_SQL.replace("WITH RECURSIVE", ",", 1) + """
SELECT chain_id, CAST(MAX(seq) AS BIGINT) AS last_seq, arg_max(output_hash, seq) AS tip_hash,
       CAST(COUNT(*) AS BIGINT) AS n_links FROM chain GROUP BY 1""", views=("governance_events",))
def chain_tips(spark, sf_dir):
    return AU.chain_tips(_gov_links(views(spark, sf_dir)))


@register("recent_governance", oracle=_GOV_CHAIN_SQL + """
SELECT chain_id, seq,
       CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || 'Z' AS timestamp,
       event_type, model_version, previous_hash, output_hash,
       CAST(json_extract_string(COALESCE(details, '{}'), '$.k') AS INT) AS details_k
FROM chain ORDER BY ts DESC, chain_id DESC, seq DESC LIMIT 100""", views=("governance_events",))
def recent_governance(spark, sf_dir):
    ev = AU.recent_events(_gov_links(views(spark, sf_dir)), 100)
    return ev.select("chain_id", "seq", "timestamp", "event_type", "model_version", "previous_hash",
                     "output_hash", F.col("details_parsed.k").alias("details_k"))


_SEGMENT_PAYLOAD_SQL = HS.canonical_sql([("n_links", "n_links"), ("segment", "day"), ("tip_hash", "tip_hash")])


@register("decision_chain_segmented", oracle=f"""
WITH RECURSIVE base AS (
  SELECT chain_id, day, ROW_NUMBER() OVER (PARTITION BY chain_id, day ORDER BY submitted_at, application_id) AS seq, {_DEC_PAYLOAD_SQL} AS payload
  FROM (SELECT r.applicant_id AS chain_id, CAST(r.submitted_at AS DATE) AS day, r.*, sha256({_INPUT_SQL}) AS input_hash FROM risk_full r) x),
seg AS (
  SELECT chain_id, day, seq, sha256(payload || '|previous_hash=null') AS output_hash FROM base WHERE seq = 1
  UNION ALL
  SELECT b.chain_id, b.day, b.seq, sha256(b.payload || '|previous_hash=' || s.output_hash)
  FROM base b JOIN seg s ON b.chain_id = s.chain_id AND b.day = s.day AND b.seq = s.seq + 1),
tips AS (SELECT chain_id, day, arg_max(output_hash, seq) AS tip_hash, CAST(COUNT(*) AS BIGINT) AS n_links FROM seg GROUP BY 1, 2),
num AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chain_id ORDER BY day) AS seq, {_SEGMENT_PAYLOAD_SQL} AS payload FROM tips),
anchor AS (
  SELECT chain_id, day, seq, n_links, tip_hash, CAST(NULL AS VARCHAR) AS previous_hash, sha256(payload || '|previous_hash=null') AS output_hash FROM num WHERE seq = 1
  UNION ALL
  SELECT n.chain_id, n.day, n.seq, n.n_links, n.tip_hash, a.output_hash, sha256(n.payload || '|previous_hash=' || a.output_hash)
  FROM num n JOIN anchor a ON n.chain_id = a.chain_id AND n.seq = a.seq + 1)
SELECT chain_id, day, seq, n_links, tip_hash, previous_hash, output_hash FROM anchor""", views=("risk_full",))
def decision_chain_segmented(spark, sf_dir):
    """H3 with hot-chain splitting: per (applicant, decision day) links + per-applicant anchor chain.

    Returns the anchor rows (one per applicant and day); the links are the
    same fold as ``decision_chain`` restricted to each day.
    """
    v = views(spark, sf_dir)
    s = v.scored.select("application_id", "applicant_id", "submitted_at", "decision", "probability",
                        *RAW_FEATURES)
    s = s.select("application_id", F.col("applicant_id").alias("chain_id"), "submitted_at", "decision",
                 "probability", F.to_date("submitted_at").alias("day"), _input_hash_col().alias("input_hash"))
    s = s.withColumn("payload", _decision_payload())
    links, anchors = AU.segmented_chain(s, "chain_id", "day", ["submitted_at", "application_id"], "payload",
                                        ["application_id", "submitted_at", "input_hash"])
    return anchors.select("chain_id", "day", "seq", "n_links", "tip_hash", "previous_hash", "output_hash")


#: Links that are folded one after another in a segment of the governance log.
SEGMENT_ROWS = 16
_GOV_SEGMENT_SQL = HS.canonical_sql([("n_links", "n_links"), ("segment", "segment"), ("tip_hash", "tip_hash")])


@register("governance_chain_segmented", oracle=f"""
WITH RECURSIVE stored AS (
  SELECT chain_id, seq AS place, event_type, COALESCE(model_version, 'unknown') AS model_version,
         '{{}}' AS input_features, '{{}}' AS output_decision, '{{}}' AS fairness_snapshot, COALESCE(details, '{{}}') AS details FROM governance_events),
base AS (SELECT chain_id, (place - 1) // {SEGMENT_ROWS} AS segment, (place - 1) % {SEGMENT_ROWS} + 1 AS seq, {_GOV_PAYLOAD_SQL} AS payload FROM stored),
seg AS (
  SELECT chain_id, segment, seq, sha256(payload || '|previous_hash=null') AS output_hash FROM base WHERE seq = 1
  UNION ALL
  SELECT b.chain_id, b.segment, b.seq, sha256(b.payload || '|previous_hash=' || s.output_hash)
  FROM base b JOIN seg s ON b.chain_id = s.chain_id AND b.segment = s.segment AND b.seq = s.seq + 1),
tips AS (SELECT chain_id, segment, arg_max(output_hash, seq) AS tip_hash, CAST(COUNT(*) AS BIGINT) AS n_links FROM seg GROUP BY 1, 2),
num AS (SELECT *, segment + 1 AS seq, {_GOV_SEGMENT_SQL} AS payload FROM tips),
anchor AS (
  SELECT chain_id, segment, seq, n_links, tip_hash, CAST(NULL AS VARCHAR) AS previous_hash, sha256(payload || '|previous_hash=null') AS output_hash FROM num WHERE seq = 1
  UNION ALL
  SELECT n.chain_id, n.segment, n.seq, n.n_links, n.tip_hash, a.output_hash, sha256(n.payload || '|previous_hash=' || a.output_hash)
  FROM num n JOIN anchor a ON n.chain_id = a.chain_id AND n.seq = a.seq + 1)
SELECT chain_id, segment, seq, n_links, tip_hash, previous_hash, output_hash FROM anchor""", views=("governance_events",))
def governance_chain_segmented(spark, sf_dir):
    """H4 with hot chains cut by number of rows: segments are folded in parallel, an anchor chain joins their tips."""
    g = _gov_stored(views(spark, sf_dir)).withColumn("payload", _gov_payload()).select("chain_id", "ts", "event_id", "payload")
    cut = AU.row_segments(g, "chain_id", ["ts", "event_id"], SEGMENT_ROWS)
    _, anchors = AU.segmented_chain(cut, "chain_id", "segment", ["ts", "event_id"], "payload", ["event_id"])
    return anchors.select("chain_id", "segment", "seq", "n_links", "tip_hash", "previous_hash", "output_hash")
