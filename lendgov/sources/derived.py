"""Derived input views: applications, risk, consent_events, governance_events, questions.

These turn the driver's tables into the loan-decision data model. The
derivation rules are fixed values shared with the DuckDB oracle; see
``plans/views_sql.py`` for the SQL text of the same rules.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as FX
from .tables import TableSet

RAW_FEATURES = ["ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term",
                "Credit_History", "Gender", "Married", "Dependents", "Education",
                "Self_Employed", "Property_Area", "mobile_usage_score",
                "transaction_stability_score", "bank_balance"]

# Fixed derivation rules (stand-in loan data from orders x customer).
_APPLICATION_EXPRS = [
    "o_orderkey AS application_id",
    "o_custkey AS applicant_id",
    "o_orderdate AS submitted_at",
    "CASE WHEN o_orderkey % 53 = 0 THEN NULL "
    "ELSE CAST(FLOOR(15000 + (c_acctbal + 1000) * 16) AS BIGINT) END AS ApplicantIncome",
    "CAST((o_orderkey * 7919) % 150000 AS BIGINT) AS CoapplicantIncome",
    "CAST(GREATEST(50000, FLOOR(o_totalprice * 5)) AS BIGINT) AS LoanAmount",
    "CASE WHEN o_orderkey % 97 = 0 THEN CAST(0 AS BIGINT) "
    "ELSE CAST(12 + (o_orderkey * 31) % 348 AS BIGINT) END AS Loan_Amount_Term",
    "CASE WHEN o_orderkey % 61 = 0 THEN NULL "
    "WHEN (o_orderkey * 17 + o_custkey) % 4 = 0 THEN 0 ELSE 1 END AS Credit_History",
    "CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_custkey % 10 < 7 THEN 'Male' "
    "ELSE 'Female' END AS Gender",
    "CASE WHEN (c_nationkey * 3 + o_custkey) % 10 < 6 THEN 'Yes' ELSE 'No' END AS Married",
    "CASE o_orderpriority WHEN '1-URGENT' THEN '0' WHEN '2-HIGH' THEN '0' "
    "WHEN '3-MEDIUM' THEN '1' WHEN '4-NOT SPECIFIED' THEN '2' ELSE '3+' END AS Dependents",
    "CASE WHEN c_mktsegment IN ('BUILDING','FURNITURE') THEN 'Not Graduate' "
    "ELSE 'Graduate' END AS Education",
    "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Yes' ELSE 'No' END AS Self_Employed",
    "CASE WHEN c_nationkey < 10 THEN 'Urban' WHEN c_nationkey < 19 THEN 'Semiurban' "
    "ELSE 'Rural' END AS Property_Area",
    "CAST(300 + (o_custkey * 131) % 650 AS BIGINT) AS mobile_usage_score",
    "CAST(300 + (o_orderkey * 211) % 650 AS BIGINT) AS transaction_stability_score",
    "CAST((o_custkey * 5381 + o_orderkey) % 800000 AS BIGINT) AS bank_balance",
]

# Event type -> consent group / governance event type.
CONSENT_GROUP_OF_EVENT = {"click": "Financial Data", "view": "Credit History Data",
                          "signup": "Demographic Data", "error": "Behaviour / Digital Data"}
CONSENT_GROUP_DEFAULT = "Banking Behaviour Data"
GOVERNANCE_TYPE_OF_EVENT = {"click": "decision", "view": "model-update", "signup": "override",
                            "error": "bias-alert"}
GOVERNANCE_TYPE_DEFAULT = "consent-change"

# Applications as requests of the month whose events change consent.
REQUEST_START, REQUEST_STEP, REQUEST_MINUTES = "2024-01-01 00:00:00", 7919, 43200

# The members of a request body. A null income is sent as null by some callers and left out by others; some give an EMI.
_BODY_MEMBERS = {
    "income": "CASE WHEN ApplicantIncome IS NOT NULL THEN concat('\"ApplicantIncome\": ', CAST(ApplicantIncome AS STRING), ', ')"
              " WHEN application_id % 2 = 0 THEN '\"ApplicantIncome\": null, ' ELSE '' END",
    "emi": "CASE WHEN application_id % 7 = 0 THEN '\"emi\": null, ' WHEN application_id % 7 = 1 THEN '\"emi\": 4321.50, ' ELSE '' END",
    "loan": "concat('\"LoanAmount\":', CAST(LoanAmount AS STRING), ',\"Loan_Amount_Term\" : ', CAST(Loan_Amount_Term AS STRING), ', ')",
    "device": "concat('\"device\": {\"os\": \"x', CAST(application_id % 4 AS STRING), '\", \"app\": {\"version\": [1, ', CAST(application_id % 5 AS STRING),"
              " ', null], \"name\": \"r\\u00e9f\"}}, ')",
    "property": "concat('\"Property_Area\": \"', Property_Area, '\", ')",
}
_BODY_LAST = "concat('\"CoapplicantIncome\": ', CAST(CoapplicantIncome AS STRING), '}')"


def _body_expr() -> str:
    orders = [list(_BODY_MEMBERS), list(_BODY_MEMBERS)[::-1], sorted(_BODY_MEMBERS)]
    cases = " ".join(f"WHEN {i} THEN concat('{{', {', '.join(_BODY_MEMBERS[m] for m in o)}, {_BODY_LAST})" for i, o in enumerate(orders))
    # one body in 41 is cut off, as by a broken connection
    return f"CASE WHEN application_id % 41 = 0 THEN '{{\"LoanAmount\": ' ELSE CASE CAST(application_id % 3 AS INT) {cases} END END"


BODY_EXPR = _body_expr()

# Question texts by intent (customer key modulo 8).
QUESTION_STEMS = ["What bank balance do I need", "What salary is needed",
                  "What EMI ratio is healthy", "Which CIBIL score is enough",
                  "How does mobile usage matter for credit", "What credit utilisation is fine",
                  "Tell me a joke", "How can I get approved"]

RISK_COLUMNS = ["application_id", "applicant_id", "submitted_at", "Gender", "Credit_History",
                "Property_Area", "LoanAmount", "bank_balance", "total_income", "emi",
                "income_to_emi_ratio", "credit_utilization", "stability_score",
                "cibil_proxy_score", "mobile_usage_score", "transaction_stability_score",
                "probability", "decision", "Approved"]


def _case_map(col: str, mapping: dict, default: str):
    expr = None
    for k, v in mapping.items():
        cond = F.col(col) == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(default))


APPLICATION_COLUMNS = ["application_id", "applicant_id", "submitted_at"] + RAW_FEATURES


class Views:
    """The derived views over one table set.

    With ``materialize=True`` (default) the scored loan dataset is written once
    per input version to the shared folder and every view over applications
    reads it; with ``False`` everything is one lazy plan from the raw tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, quantile_accuracy: int = 10000,
                 materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = TableSet(spark, sf_dir)
        self.quantile_accuracy = quantile_accuracy
        self.materialize = materialize

    @cached_property
    def applications(self) -> DataFrame:
        if self.materialize:
            return self.scored.select(*APPLICATION_COLUMNS)
        return self.applications_from_raw

    @cached_property
    def applications_from_raw(self) -> DataFrame:
        return self._orders_with_customers().selectExpr(*_APPLICATION_EXPRS)

    def _orders_with_customers(self) -> DataFrame:
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice",
                                 "o_orderpriority")
        c = self.t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
        # Fact x dimension equi join; Catalyst/AQE pick broadcast only when the
        # customer side measures under the broadcast threshold at run time.
        return o.join(c, o.o_custkey == c.c_custkey, "inner")

    def _code_files(self, *extra_modules):
        from ..functions import features as _fx, quantiles as _q
        return [__file__, _fx.__file__, _q.__file__, *[m.__file__ for m in extra_modules]]

    def _materialized(self, name, code, build, extra):
        """Read the materialized table, building it first where it is missing; a failure is raised."""
        from . import materialize as M
        return M.materialized(self.spark, name, self._inputs(), code, build, extra=extra)

    def stored(self, name: str, build, modules=(), tables=("orders", "customer")) -> DataFrame:
        """The table that ``build()`` plans, written once per version of the tables and modules it comes from
        (not written without materialization; not even planned where it is there already)."""
        if not self.materialize:
            return build()
        from . import materialize as M
        import os as _os
        inputs = [_os.path.join(self.sf_dir, f"{n}.parquet") for n in tables]
        return M.materialized(self.spark, name, inputs, self._code_files(*modules), build, extra=f"acc={self.quantile_accuracy}")

    def stored_model(self, name: str, fit, modules=()):
        """The pipeline that ``fit()`` trains, saved once per version of the loan data and modules."""
        if not self.materialize:
            return fit()
        from pyspark.ml import PipelineModel
        from . import materialize as M
        path = M.published(self.spark, f"model-{name}", self._inputs(), self._code_files(*modules), lambda tmp: fit().save(tmp),
                           extra=f"acc={self.quantile_accuracy}", marker="metadata/_SUCCESS")
        return PipelineModel.load(path)

    def _inputs(self):
        import os as _os
        return [_os.path.join(self.sf_dir, f"{n}.parquet") for n in ("orders", "customer")]

    @cached_property
    def features(self) -> DataFrame:
        """applications + training-time engineered features (F1-F5), no global stats.

        Materialized first: the statistics passes of the scored table then scan
        three columns of this table instead of recomputing the join.

        Written sorted by decision time within each task (a local sort, no
        shuffle), and the scored table keeps that order, so Parquet row-group
        min/max statistics let time-window filters (trailing-days dashboards)
        skip most of it. The eight raw columns are sorted, before the features
        are computed: the wide rows of a large file do not fit a task's memory.
        """
        build = lambda: FX.with_train_features(
            self._orders_with_customers().sortWithinPartitions("o_orderdate").selectExpr(*_APPLICATION_EXPRS))
        if not self.materialize:
            return build()
        return self._materialized("features", self._code_files(), build, "")

    def build_scored(self) -> DataFrame:
        """The scored loan dataset from the features table, row by row in its order."""
        return FX.with_risk(self.features, accuracy=self.quantile_accuracy)

    @cached_property
    def scored(self) -> DataFrame:
        """Every application column + engineered features, risk score, probability, decision, label."""
        if not self.materialize:
            return self.build_scored()
        return self._materialized("scored", self._code_files(), self.build_scored, f"acc={self.quantile_accuracy}")

    @cached_property
    def risk(self) -> DataFrame:
        """features + cibil proxy (F6), risk score (F8), probability (F9), decision, label."""
        return self.scored.select(*RISK_COLUMNS)

    @cached_property
    def scorecard_params(self) -> DataFrame:
        """Fitted scorecard parameters (medians, means) of the scored table: one row."""
        from ..operators import scoring as SC
        inputs = [c for c, _, _ in SC.TERMS]
        build = lambda: SC.params(self.scored.select(*inputs), self.quantile_accuracy)
        if not self.materialize:
            return build()
        return self._materialized("scorecard_params", self._code_files(SC), build, f"acc={self.quantile_accuracy}")

    @cached_property
    def consent_events(self) -> DataFrame:
        e = self.t.events.select("event_id", "ts", "user_id", "event_type", "props")
        return e.select(
            "event_id", "ts", F.col("user_id").alias("applicant_id"),
            _case_map("event_type", CONSENT_GROUP_OF_EVENT, CONSENT_GROUP_DEFAULT).alias("group_name"),
            (F.get_json_object("props", "$.k").try_cast("int") % 3 != 0).alias("allowed"))

    @cached_property
    def requests(self) -> DataFrame:
        """The scored applications as requests of the month in which consent changes: ``requested_at``."""
        minutes = F.expr(f"make_dt_interval(0, 0, cast((application_id * {REQUEST_STEP}) % {REQUEST_MINUTES} as int), 0)")
        return self.scored.withColumn("requested_at", F.lit(REQUEST_START).cast("timestamp_ntz") + minutes)

    @cached_property
    def request_bodies(self) -> DataFrame:
        """Each application as the JSON text that a caller might send: keys in any order, white space, nested parts, absent and null keys."""
        return self.applications.select("application_id", F.expr(BODY_EXPR).alias("body"))

    @cached_property
    def governance_events_unsequenced(self) -> DataFrame:
        """Governance events without the per-chain sequence number (chain folds number them)."""
        e = self.t.events.select("event_id", "ts", "user_id", "event_type", "props")
        return e.select(
            F.col("user_id").alias("chain_id"), "event_id", "ts",
            _case_map("event_type", GOVERNANCE_TYPE_OF_EVENT, GOVERNANCE_TYPE_DEFAULT).alias("event_type"),
            F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string"))
             .otherwise(F.lit("indian_v1")).alias("model_version"),
            F.col("props").alias("details"))

    @cached_property
    def governance_events(self) -> DataFrame:
        """The FIXTURES view with its dense per-chain ``seq`` (a window per chain; chain
        folds number links themselves and read ``governance_events_unsequenced``)."""
        from pyspark.sql import Window
        e = self.t.events.select("event_id", "ts", "user_id", "event_type", "props")
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return e.select(
            F.col("user_id").alias("chain_id"),
            F.row_number().over(w).cast("bigint").alias("seq"),
            "ts",
            _case_map("event_type", GOVERNANCE_TYPE_OF_EVENT, GOVERNANCE_TYPE_DEFAULT).alias("event_type"),
            F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string"))
             .otherwise(F.lit("indian_v1")).alias("model_version"),
            F.col("props").alias("details"))

    @cached_property
    def questions(self) -> DataFrame:
        c = self.t.customer.select("c_custkey")
        stem = F.element_at(F.array(*[F.lit(s) for s in QUESTION_STEMS]),
                            (F.col("c_custkey") % 8 + 1).cast("int"))
        suffix = F.when(F.col("c_custkey") % 3 == 0, F.lit("?")).otherwise(
            F.concat(F.lit(" for a loan of "),
                     ((F.col("c_custkey") % 20 + 1) * 100000).cast("string"), F.lit("?")))
        asked = F.date_add(F.lit("1992-06-01").cast("date"), (F.col("c_custkey") * 37 % 2200).cast("int"))
        return c.select(F.col("c_custkey").alias("question_id"),
                        F.col("c_custkey").alias("applicant_id"), asked.cast("timestamp_ntz").alias("asked_at"),
                        F.concat(stem, suffix).alias("question"))
