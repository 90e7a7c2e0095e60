"""Consent: feature groups, latest consent state, masking, access log, changes.

Storage form of consent is the long event table (applicant_id, group_name,
allowed, ts, event_id); the latest state per (applicant, group) is a
last-write-wins aggregate (partial, skew-safe). Groups without events default
to allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Consent groups in display order, with their candidate raw
# columns (kept only if present) and the engineered features always attached.
GROUP_CANDIDATES = [
    ("Financial Data", ["ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term"]),
    ("Credit History Data", ["Credit_History"]),
    ("Demographic Data", ["Gender", "Married", "Dependents", "Education", "Self_Employed",
                          "Property_Area"]),
    ("Behaviour / Digital Data", ["mobile_usage_score", "transaction_stability_score",
                                  "digital_footprint", "transaction_score"]),
    ("Banking Behaviour Data", ["AvgBalance", "TransactionScore"]),
]
GROUP_ENGINEERED = {
    "Financial Data": ["total_income", "emi", "income_to_emi_ratio", "credit_utilization"],
    "Behaviour / Digital Data": ["stability_score"],
    "Credit History Data": ["cibil_proxy_score"],
}
ALL_GROUPS = [g for g, _ in GROUP_CANDIDATES]
MODEL_VERSION = "indian_v1"


def group_candidates(spark: SparkSession) -> DataFrame:
    rows = []
    for gi, (g, cols) in enumerate(GROUP_CANDIDATES):
        for fi, c in enumerate(cols):
            rows.append((g, gi, c, fi, False))
        for fj, c in enumerate(GROUP_ENGINEERED.get(g, [])):
            rows.append((g, gi, c, 100 + fj, True))
    return spark.createDataFrame(
        rows, "group_name string, group_order int, feature string, feature_order int, engineered boolean")


def feature_groups(dataset: DataFrame) -> DataFrame:
    """J3 + J1: dataset-driven groups and the feature -> group map (first group wins).

    Candidates are kept if the column exists (left-semi join against the
    dataset's column list, taken from the schema), engineered features are
    always attached, and groups left empty disappear.
    """
    spark = dataset.sparkSession
    cols = spark.createDataFrame([(c,) for c in dataset.columns], "feature string")
    cand = group_candidates(spark)
    kept = cand.where(~F.col("engineered")).join(F.broadcast(cols), "feature", "left_semi") \
        .unionByName(cand.where(F.col("engineered")))
    first = kept.groupBy("feature").agg(
        F.min_by(F.struct("group_name", "group_order", "feature_order"), F.col("group_order")).alias("g"))
    return first.select(F.col("g.group_name").alias("group_name"), F.col("g.group_order").alias("group_order"),
                        "feature", F.col("g.feature_order").alias("feature_order"))


def group_map(columns: Sequence[str]) -> dict[str, str]:
    """feature -> group for a dataset with these columns, by the rules of ``feature_groups`` (schema only)."""
    out: dict[str, str] = {}
    for g, cols in GROUP_CANDIDATES:
        for c in [c for c in cols if c in columns] + GROUP_ENGINEERED.get(g, []):
            out.setdefault(c, g)
    return out


def known_groups(columns: Sequence[str]) -> list[str]:
    """Groups that have a feature in the dataset, in display order."""
    used = set(group_map(columns).values())
    return [g for g in ALL_GROUPS if g in used]


def next_event_id(events: DataFrame) -> int:
    """An id above every stored event's, for the next save."""
    return int(events.agg(F.coalesce(F.max("event_id"), F.lit(-1))).first()[0]) + 1


def latest_consent(events: DataFrame) -> DataFrame:
    """Last-write-wins consent per (applicant, group) by (ts, event_id)."""
    return events.groupBy("applicant_id", "group_name").agg(
        F.max_by("allowed", F.struct("ts", "event_id")).alias("allowed"),
        F.max("ts").alias("updated_at"))


def consent_state(applicants: DataFrame, events: DataFrame, groups: Sequence[str]) -> DataFrame:
    """S7 + J2: every applicant x known group; a group without events is allowed.

    The fixed group list is expanded per row (no join); latest state joins on
    (applicant, group).
    """
    grid = applicants.select("applicant_id", F.explode(F.array(*[F.lit(g) for g in groups])).alias("group_name"))
    lat = latest_consent(events.where(F.col("group_name").isin(*groups)))
    return grid.join(lat, ["applicant_id", "group_name"], "left").select(
        "applicant_id", "group_name", F.coalesce("allowed", F.lit(True)).alias("allowed"),
        F.col("allowed").isNull().alias("is_default"))


def flag_col(group: str) -> str:
    return "ok_" + "".join(ch if ch.isalnum() else "_" for ch in group)


def flags_from_events(events: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per applicant with events: latest allowed flag per group (null: no event).

    One partial aggregate (max_by skips rows whose ordering is null), no grid.
    """
    order = F.struct("ts", "event_id")
    return events.groupBy("applicant_id").agg(*[
        F.max_by(F.when(F.col("group_name") == g, F.col("allowed")),
                 F.when(F.col("group_name") == g, order)).alias(flag_col(g)) for g in groups])


def with_flags(df: DataFrame, events: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Attach per-group allowed flags to rows keyed by applicant_id (no event -> allowed)."""
    flags = flags_from_events(events, groups)
    j = df.join(flags, "applicant_id", "left")
    return j.select(*df.columns, *[F.coalesce(F.col(flag_col(g)), F.lit(True)).alias(flag_col(g)) for g in groups])


def with_flags_as_of(df: DataFrame, events: DataFrame, groups: Sequence[str], at: str, id_col: str = "application_id") -> DataFrame:
    """Per-group allowed flags as they stood when each row was submitted (``at``): the last event of the applicant and group
    at or before that time decides, and a group without one is allowed.

    Events and rows lie in one range-partitioned order, so an applicant with many of both is spread over tasks and nothing is
    joined on the applicant. ``id_col`` is unique.
    """
    from ..functions.prefix import last_known
    flags = [flag_col(g) for g in groups]
    said = events.select(F.col("applicant_id").alias("_who"), F.col("ts").alias("_at"), F.lit(0).alias("_kind"), F.col("event_id").alias("_tie"),
                         *[F.when(F.col("group_name") == g, F.col("allowed")).alias(f"_said_{i}") for i, g in enumerate(groups)])
    asked = df.select(F.col("applicant_id").alias("_who"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.col(id_col).alias("_tie"),
                      F.struct(*df.columns).alias("_row"))
    both = said.unionByName(asked, allowMissingColumns=True)
    found = last_known(both, ["_who"], ["_at", "_kind", "_tie"], [f"_said_{i}" for i in range(len(groups))], flags)
    return found.where(F.col("_kind") == 1).select("_row.*", *[F.coalesce(c, F.lit(True)).alias(c) for c in flags])


def mask_drop(df: DataFrame, feature_group: dict[str, str], features: Sequence[str]) -> DataFrame:
    """Null out features whose group is denied; ungrouped features pass."""
    out = []
    for c in df.columns:
        if c in features and c in feature_group:
            out.append(F.when(F.col(flag_col(feature_group[c])), F.col(c)).alias(c))
        elif not c.startswith("ok_"):
            out.append(F.col(c))
    return df.select(*out)


def mask_neutral(df: DataFrame, feature_group: dict[str, str], numeric: Sequence[str],
                 categorical: Sequence[str]) -> DataFrame:
    """Denied numeric -> 0, denied categorical -> 'missing', other denied -> null."""
    out = []
    for c in df.columns:
        if c.startswith("ok_"):
            continue
        if c in feature_group:
            ok = F.col(flag_col(feature_group[c]))
            if c in numeric:
                repl = F.lit(0).cast(df.schema[c].dataType)
            elif c in categorical:
                repl = F.lit("missing").cast(df.schema[c].dataType)
            else:
                repl = F.lit(None).cast(df.schema[c].dataType)
            out.append(F.when(ok, F.col(c)).otherwise(repl).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def access_records(df: DataFrame, feature_group: dict[str, str], features: Sequence[str],
                   ts: str = "ts", model_version: str = MODEL_VERSION) -> DataFrame:
    """One access record per (row, feature touched): allowed flag of its group.

    Unpivot by exploding a fixed array, so it stays one narrow stage.
    """
    recs = []
    for i, f in enumerate(features):
        ok = F.col(flag_col(feature_group[f])) if f in feature_group else F.lit(True)
        recs.append(F.struct(F.lit(i).alias("feature_order"), F.lit(f).alias("feature"), ok.alias("allowed")))
    return df.select("application_id", "applicant_id", F.col(ts).alias("ts"),
                     F.explode(F.array(*recs)).alias("r")).select(
        "application_id", "applicant_id", "ts", F.col("r.feature_order").alias("feature_order"),
        F.col("r.feature").alias("feature"), F.col("r.allowed").alias("allowed"),
        F.lit(model_version).alias("model_version"))


def recent_access(log: DataFrame, limit: int = 100) -> DataFrame:
    """Newest access records first (top-N report)."""
    return log.orderBy(F.col("ts").desc(), F.col("application_id").desc(), F.col("feature_order").desc()) \
        .limit(limit)


def last_access_local(log: DataFrame, tz: str = "Asia/Kolkata", suffix: str = "IST") -> DataFrame:
    """X11 + W7(N=1): last access per applicant, as UTC and as local text."""
    last = log.groupBy("applicant_id").agg(F.max("ts").alias("last_access_utc"))
    local = F.from_utc_timestamp(F.col("last_access_utc").cast("timestamp"), tz)
    return last.select("applicant_id", "last_access_utc",
                       F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" " + suffix))
                       .alias("last_access_local"))


def consent_changes(events: DataFrame) -> DataFrame:
    """Each event that flips a group's state (previous state defaults to allowed).

    The previous state comes from a distributed lag over (applicant, group), so
    an applicant with a huge event history is split across tasks.
    """
    from ..functions.prefix import distributed_lag
    ev = events.select("applicant_id", "group_name", "event_id", "ts", "allowed")
    lagged = distributed_lag(ev, ["applicant_id", "group_name"], ["ts", "event_id"], "allowed", True, "_prev")
    return lagged.where(F.col("allowed") != F.col("_prev")) \
        .select("applicant_id", "group_name", "event_id", "ts",
                F.when(F.col("allowed"), F.lit("enabled")).otherwise(F.lit("disabled")).alias("change"))


# Profile defaults used when an applicant has no stored profile.
PROFILE_DEFAULTS = {
    "ApplicantIncome": 60000, "CoapplicantIncome": 10000, "LoanAmount": 800000,
    "Loan_Amount_Term": 180, "Credit_History": 1, "Gender": "Male", "Married": "Yes",
    "Dependents": "0", "Education": "Graduate", "Self_Employed": "No",
    "Property_Area": "Urban", "mobile_usage_score": 700, "transaction_stability_score": 750,
    "bank_balance": 150000,
}


def profiles(applicants: DataFrame, applications: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Latest application per applicant as the stored profile; all defaults if none.

    Last-write-wins by (submitted_at, application_id) with a partial max_by.
    """
    latest = applications.groupBy("applicant_id").agg(
        F.max_by(F.struct(*fields), F.struct("submitted_at", "application_id")).alias("p"))
    j = applicants.join(latest, "applicant_id", "left")
    has = F.col("p").isNotNull()
    cols = []
    for f in fields:
        d = F.lit(PROFILE_DEFAULTS[f]).cast(applications.schema[f].dataType)
        cols.append(F.when(has, F.col("p")[f]).otherwise(d).alias(f))
    return j.select("applicant_id", has.alias("has_profile"), *cols)


def state_events(states: DataFrame, groups: Sequence[str], ts_col: str = "ts",
                 first_event_id: int = 0) -> DataFrame:
    """Save consent: wide per-applicant flags (one boolean column per group) -> appended events.

    Unknown columns are ignored; a group missing from ``states`` is not written
    (so it keeps its stored value, which defaults to allowed). ``first_event_id`` must lie above
    all stored ids (``next_event_id``): of two saves at one time the later id wins.
    """
    present = [g for g in groups if g in states.columns]
    recs = F.array(*[F.struct(F.lit(i).alias("gi"), F.lit(g).alias("group_name"), F.col(g).cast("boolean").alias("allowed"))
                     for i, g in enumerate(present)])
    long = states.select("applicant_id", F.col(ts_col).alias("ts"), F.explode(recs).alias("r")) \
        .where(F.col("r.allowed").isNotNull())
    # event ids continue after the stored ones; deterministic per (applicant, group)
    return long.select((F.lit(first_event_id) + F.col("applicant_id") * len(groups) + F.col("r.gi")).alias("event_id"),
                       "ts", "applicant_id", F.col("r.group_name").alias("group_name"),
                       F.col("r.allowed").alias("allowed"))


def reset_events(applicants: DataFrame, groups: Sequence[str], ts, first_event_id: int = 0) -> DataFrame:
    """Reset consent: an all-allowed event for every known group of every applicant."""
    wide = applicants.select("applicant_id", F.lit(ts).alias("ts"), *[F.lit(True).alias(g) for g in groups])
    return state_events(wide, groups, "ts", first_event_id)
