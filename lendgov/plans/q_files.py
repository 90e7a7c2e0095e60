"""Operators on files, saved models and prepared rows as queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import consent as CO
from ..operators import explain as EX
from ..operators import fairness as FA
from ..operators import kernel_shap as KS
from ..operators import prep as PR
from ..operators import retrieval as RT
from ..operators import scoring as SC
from ..operators import training as TR
from ..sources import files as FS
from ..sources.derived import APPLICATION_COLUMNS
from ..sources.incremental import AppendedLoans
from .common import round_doubles, views
from .q_advice import _GUIDE_SQL, _TEXTS_SQL, _texts
from .q_consent import _ACCESS_SQL, SERVE_FEATURES, _served_with_flags, feature_group_map
from .q_models import CATS, NUMERIC, _LEVELS_SQL, _MED_SQL, _SPLIT_FULL, _split_frame, trained
from .q_streaming import _LINE_EXPR, _run_dir
from .registry import register

_LOANS = [f.name for f in FS.LOAN_SCHEMA.fields]
_WANTED = ["application_id", *_LOANS, "Loan_ID"]  # the last one no file has
_DOUBLES = {f.name for f in FS.LOAN_SCHEMA.fields if isinstance(f.dataType, T.DoubleType)}


@register("csv_round_trip", oracle="SELECT " + ", ".join(
    "CAST(NULL AS VARCHAR) AS Loan_ID" if c == "Loan_ID" else f"ROUND({c}, 6) AS {c}" if c in _DOUBLES else c for c in _WANTED) + " FROM risk_full",
          views=("risk_full",))
def csv_round_trip(spark, sf_dir):
    """The loan table written as CSV without an index, its header looked at for the wanted columns, and read back with its schema."""
    path = os.path.join(_run_dir(spark, "csv"), "loans.csv")
    FS.write_csv(views(spark, sf_dir).scored.select("application_id", *_LOANS), path)
    have = FS.header_columns(spark, path)
    schema = T.StructType([T.StructField("application_id", T.LongType()), *FS.LOAN_SCHEMA.fields])
    loans = FS.read_loans_csv(spark, path, T.StructType([schema[c] for c in have]))
    return round_doubles(loans.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in _WANTED]))


_CREDIT_G = ("CASE WHEN Approved = 1 THEN 'good' ELSE 'bad' END AS class", "concat_ws(' ', Gender, Married) AS personal_status", "LoanAmount AS credit_amount",
             "Loan_Amount_Term AS duration", "probability AS score", "Property_Area AS housing")


def _credit_g(spark, sf_dir, name="credit_g", drop=()):
    """The loan rows in the shape of the alternate dataset, cached as a CSV file and read from there."""
    path = os.path.join(_run_dir(spark, name), "credit_data.csv")
    FS.write_csv(views(spark, sf_dir).scored.selectExpr("application_id", *_CREDIT_G).drop(*drop), path)
    return FS.read_credit_g(spark, path)


@register("credit_g_fairness", oracle=f"""
WITH g AS (SELECT application_id, {', '.join(_CREDIT_G)} FROM risk_full)
SELECT 'personal_status' AS sensitive_feature, personal_status AS group_value, CAST(COUNT(*) AS BIGINT) AS n_rows,
  CAST(COUNT(*) FILTER (WHERE class = 'good') AS BIGINT) AS n_good, ROUND(AVG(CASE WHEN score >= 0.5e0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS selection_rate,
  ROUND((SELECT AVG(CASE WHEN score >= 0.5e0 THEN 1.0e0 ELSE 0.0e0 END) FROM g), 6) AS overall_selection_rate,
  CAST(4 AS BIGINT) AS n_numeric, CAST(3 AS BIGINT) AS n_categorical FROM g GROUP BY 2""", views=("risk_full",))
def credit_g_fairness(spark, sf_dir):
    """The alternate dataset from its cached file, its columns by type, its text target as label, and the rates of the
    first sensitive attribute that it has."""
    g = _credit_g(spark, sf_dir)
    numeric, cats = PR.split_by_dtype(g)
    attr = FA.pick_sensitive(g)
    _, rates = FA.dataset_fairness(g, F.col("score"))
    good = g.groupBy(FA.group_label(attr).alias("group_value")).agg(F.sum(FA.label_from_class("class")).alias("n_good"))
    return round_doubles(rates.join(good, "group_value").select("sensitive_feature", "group_value", "n_rows", "n_good", "selection_rate", "overall_selection_rate",
                                                                F.lit(len(numeric)).cast("bigint").alias("n_numeric"), F.lit(len(cats)).cast("bigint").alias("n_categorical")))


@register("dataset_availability", oracle="""
SELECT v.dataset, v.available, v.reason, CASE WHEN v.available THEN CAST((SELECT COUNT(*) FROM risk_full) AS BIGINT) END AS n_rows FROM (VALUES
  ('whole', TRUE, NULL), ('without target', FALSE, 'No ''class'' column in dataset'), ('without attribute', FALSE, 'No suitable sensitive attribute found'),
  ('no file', FALSE, 'credit_data.csv not found')) v(dataset, available, reason)""", views=("risk_full",))
def dataset_availability(spark, sf_dir):
    """Whether a dataset can be judged, and why not."""
    sets = {"whole": _credit_g(spark, sf_dir), "without target": _credit_g(spark, sf_dir, drop=["class"]),
            "without attribute": _credit_g(spark, sf_dir, drop=["personal_status"]),
            "no file": FS.read_credit_g(spark, os.path.join(_run_dir(spark, "none"), "credit_data.csv"))}
    rows = []
    for name, df in sets.items():
        ok, reason = FS.availability(df)
        rows.append((name, ok, reason, df.count() if ok else None))
    return spark.createDataFrame(rows, "dataset string, available boolean, reason string, n_rows bigint")


@register("access_log_read", oracle=_ACCESS_SQL + """
SELECT feature, allowed, model_version, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM log
WHERE application_id % 29 NOT IN (0, 1)""", views=("applications", "consent_events"))
def access_log_read(spark, sf_dir):
    """The access log read from JSON lines of which some are cut off or blank."""
    src = os.path.join(_run_dir(spark, "log"), "src")
    log = CO.access_records(PR.spread(_served_with_flags(views(spark, sf_dir))), feature_group_map(), SERVE_FEATURES, ts="submitted_at")
    lines = log.select("application_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "feature", "allowed", "model_version")).alias("value"))
    FS.write_log_lines(lines.select(F.expr(f"CASE WHEN application_id % 29 IN (0, 1) THEN {_LINE_EXPR} ELSE value END").alias("value")), src)
    return FS.read_access_log(spark, src).select("feature", "allowed", "model_version", "timestamp")


@register("guidance_hits", oracle=f"""
WITH {_TEXTS_SQL}, {_GUIDE_SQL.split("bullets AS (")[0].rstrip().rstrip(",")},
top AS (SELECT i FROM (SELECT i, ROW_NUMBER() OVER (PARTITION BY source, item_id, turn ORDER BY s DESC, i) AS rn FROM scored) z WHERE rn <= 3)
SELECT CAST(g.i AS INT) AS doc_id, g.t AS text, CAST(COUNT(top.i) AS BIGINT) AS hits FROM guide g LEFT JOIN top ON g.i = top.i GROUP BY 1, 2""", views=("questions",))
def guidance_hits(spark, sf_dir):
    """The guidance corpus as a table, with how many texts have each snippet among their three nearest."""
    hits = _texts(views(spark, sf_dir)).select(F.explode(RT.guidance_topk(F.col("text"))).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return RT.guidance_corpus(spark).join(hits, "text", "left").select("doc_id", "text", F.coalesce("n", F.lit(0)).cast("bigint").alias("hits"))


_MU_SD = ", ".join(f"AVG(COALESCE(CAST(t.{c} AS DOUBLE), med_{c})) AS mu_{c}, STDDEV_POP(COALESCE(CAST(t.{c} AS DOUBLE), med_{c})) AS sd_{c}" for c in NUMERIC)
_MODES = ", ".join(f"(SELECT CAST({c} AS VARCHAR) FROM train WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS mode_{c}" for c in CATS)
_NUMBERS = " UNION ALL ".join(
    f"SELECT application_id, label, {i} AS position, (COALESCE(CAST({c} AS DOUBLE), med_{c}) - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0e0 ELSE sd_{c} END AS value "
    f"FROM test CROSS JOIN m CROSS JOIN s" for i, c in enumerate(NUMERIC))
_TEXTS = " UNION ALL ".join(f"SELECT application_id, label, '{c}' AS feature, COALESCE(CAST({c} AS VARCHAR), mode_{c}) AS own FROM test CROSS JOIN modes" for c in CATS)


@register("feature_vectors", oracle=f"""
WITH {_SPLIT_FULL},
rows AS (SELECT r.*, r.Approved AS label, s.is_test FROM risk_full r JOIN split s ON r.application_id = s.application_id),
train AS (SELECT * FROM rows WHERE NOT is_test), test AS (SELECT * FROM rows WHERE is_test),
m AS (SELECT {_MED_SQL} FROM train), s AS (SELECT {_MU_SD} FROM train t CROSS JOIN m), modes AS (SELECT {_MODES}),
lv AS (SELECT DISTINCT o, feature, level FROM ({_LEVELS_SQL}) q UNION ALL SELECT DISTINCT o, feature, CAST(NULL AS VARCHAR) FROM ({_LEVELS_SQL}) q),
slot AS (SELECT feature, level, {len(NUMERIC)} + ROW_NUMBER() OVER (ORDER BY o, level NULLS LAST) - 1 AS position FROM lv),
own AS ({_TEXTS})
SELECT application_id, label, CAST(position AS INT) AS position, ROUND(value, 6) + 0.0e0 AS value FROM ({_NUMBERS}) n
UNION ALL SELECT application_id, label, CAST(position AS INT), CASE WHEN own = level THEN 1.0e0 ELSE 0.0e0 END FROM own JOIN slot ON own.feature = slot.feature""",
          views=("risk_full",))
def feature_vectors(spark, sf_dir):
    """P1 + M5: label and assembled vector of every row of the test split, position by position, as the fitted preprocessing makes it."""
    model, fill, data = trained(spark, sf_dir, "logistic")
    x = TR.vectors(model, TR.filled(data.where("is_test"), fill, CATS), ["application_id", "label"])
    return x.select("application_id", "label", F.posexplode("columns").alias("position", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


@register("background_rows", oracle=f"""
WITH {_SPLIT_FULL}
SELECT application_id, ROW_NUMBER() OVER (ORDER BY h, application_id) AS place FROM (
  SELECT application_id, {PR.split_hash_sql('application_id')} AS h FROM split WHERE NOT is_test ORDER BY h, application_id LIMIT 100) x""", views=("risk_full",))
def background_rows(spark, sf_dir):
    """The 100 training rows that explanations are taken against."""
    bg = KS.background_sample(_split_frame(views(spark, sf_dir)).where("not is_test").select("application_id"), "application_id", 100)
    ids = [r["application_id"] for r in bg.collect()]  # 100 rows, in their order
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "application_id bigint, place bigint")


_ZERO = [c for c, _, _ in SC.TERMS]


@register("zero_attributions", oracle=" UNION ALL ".join(
    f"SELECT application_id, {i} AS feature_idx, '{c}' AS feature, ROUND(CAST({c} AS DOUBLE), 6) AS value, 0.0e0 AS shap FROM risk_full" for i, c in enumerate(_ZERO)), views=("risk_full",))
def zero_attributions(spark, sf_dir):
    """What is explained when no model can be."""
    rows = EX.zero_attribution(views(spark, sf_dir).scored, _ZERO)
    return round_doubles(rows.select("application_id", F.explode("attr").alias("r")).select("application_id", "r.*"))


@register("model_save_load", oracle=f"""
SELECT application_id, 0.0e0 AS reloaded_gap, 0.0e0 AS weights_gap, CAST({len(NUMERIC + CATS)} AS BIGINT) AS n_features FROM risk_full""", views=("risk_full",))
def model_save_load(spark, sf_dir):
    """S5 + M14: the pipeline saved with its feature list and loaded again scores as before, and as its weights say without it."""
    model, fill, data = trained(spark, sf_dir, "logistic")
    path = os.path.join(_run_dir(spark, "model"), "pipeline")
    TR.save(model, path, NUMERIC + CATS)
    features, rows = TR.load_features(path), TR.filled(data, fill, CATS)
    parts, bias = TR.logit_parts(model, NUMERIC, CATS)
    own = rows.select("application_id", SC.sigmoid(sum(parts[1:], parts[0]) + F.lit(bias)).alias("w"))
    both = (TR.positive_probability(model, rows, ["application_id"]).join(TR.positive_probability(TR.load(path), rows, ["application_id"]).withColumnRenamed("p", "q"), "application_id")
            .join(own, "application_id"))
    gap = lambda c: F.abs(F.round(F.col("p") - F.col(c), 9))
    return both.select("application_id", gap("q").alias("reloaded_gap"), gap("w").alias("weights_gap"), F.lit(len(features)).cast("bigint").alias("n_features"))


@register("appended_scores", oracle="SELECT application_id, ROUND(cibil_proxy_score, 6) AS cibil_proxy_score, ROUND(risk_score, 6) AS risk_score, "
          "ROUND(probability, 6) AS probability, decision, Approved, TRUE AS only_new_files_read FROM risk_full", views=("risk_full",))
def appended_scores(spark, sf_dir):
    """F6, F8, F9 for applications that come in three lots of files: with each lot only its files are read, and all scores are those of a full build."""
    d = _run_dir(spark, "appended")
    src = os.path.join(d, "src")
    apps = views(spark, sf_dir).applications.select(*APPLICATION_COLUMNS)
    loans, seen, only_new = AppendedLoans(spark, src, os.path.join(d, "store")), set(), True
    for lot in range(3):
        apps.where(F.pmod(F.col("applicant_id"), F.lit(3)) == lot).write.mode("append").parquet(src)
        read = set(loans.refresh())
        only_new, seen = only_new and bool(read) and not read & seen, seen | read
    return round_doubles(loans.scored().select("application_id", "cibil_proxy_score", "risk_score", "probability", "decision", "Approved",
                                               F.lit(only_new).alias("only_new_files_read")))
