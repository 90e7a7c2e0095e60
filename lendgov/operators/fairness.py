"""Group fairness: selection rates, disparate impact, parity difference, bias alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed alert thresholds: disparate impact below 0.8, parity difference above 0.2.
DI_THRESHOLD = 0.8
SPD_THRESHOLD = 0.2
# Fixed candidate order for the sensitive attribute of the credit-g schema.
SENSITIVE_CANDIDATES = ["sex", "personal_status", "personal_status_sex"]


def pick_sensitive(df: DataFrame, candidates: Sequence[str] = SENSITIVE_CANDIDATES) -> str | None:
    """First candidate column present (schema only, no job)."""
    for c in candidates:
        if c in df.columns:
            return c
    return None


def group_label(col: str):
    """Sensitive value as text; a missing value forms its own group 'nan'."""
    return F.coalesce(F.col(col).cast("string"), F.lit("nan"))


def selection_rates(df: DataFrame, attributes: Sequence[str], pred: str = "y_pred") -> DataFrame:
    """A5 + A6 for several attributes in one scan.

    Each row is unpivoted to (attribute, value) pairs and aggregated with
    partial (map-side) sums, so a hot group costs one counter per task.
    Returns sensitive_feature, group_value, n_rows, selection_rate,
    overall_selection_rate.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), group_label(a).alias("g"))
                                for a in attributes]))
    long = df.select(F.col(pred).cast("double").alias("_y"), pairs.alias("_p"))
    g = long.groupBy(F.col("_p.a").alias("sensitive_feature"), F.col("_p.g").alias("group_value")) \
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_y").alias("_s"))
    # Overall rate from the small per-group table, not a second scan.
    tot = g.groupBy("sensitive_feature").agg(
        (F.sum("_s") / F.sum("n_rows")).alias("overall_selection_rate"))
    return g.join(tot, "sensitive_feature").select(
        "sensitive_feature", "group_value", "n_rows",
        (F.col("_s") / F.col("n_rows")).alias("selection_rate"), "overall_selection_rate")


def disparity(rates: DataFrame, reference_group: str | None = None,
              comparison_group: str | None = None) -> DataFrame:
    """A8 + A9 per attribute: min/max ratio and max-min difference.

    With ``reference_group``/``comparison_group`` the ratio is the fixed pair
    form comparison/reference instead of min/max.
    """
    agg = rates.groupBy("sensitive_feature").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("selection_rate").alias("min_rate"), F.max("selection_rate").alias("max_rate"),
        F.max(F.when(F.col("group_value") == F.lit(reference_group), F.col("selection_rate"))).alias("_ref"),
        F.max(F.when(F.col("group_value") == F.lit(comparison_group), F.col("selection_rate"))).alias("_cmp"))
    defined = F.col("max_rate") > 0
    if reference_group is not None:
        di = F.when(F.col("_ref") > 0, F.col("_cmp") / F.col("_ref"))
    else:
        di = F.when(defined, F.col("min_rate") / F.col("max_rate"))
    return agg.select("sensitive_feature", "n_groups", "min_rate", "max_rate",
                      di.alias("disparate_impact"),
                      F.when(defined, F.col("max_rate") - F.col("min_rate"))
                      .alias("statistical_parity_difference"))


def bias_alerts(disp: DataFrame, di_threshold: float = DI_THRESHOLD,
                spd_threshold: float = SPD_THRESHOLD) -> DataFrame:
    """A10: one row per crossed threshold (strict comparisons)."""
    long = disp.select("sensitive_feature", F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("disparate_impact").alias("metric"),
                 F.col("disparate_impact").alias("value"), F.lit(di_threshold).alias("threshold"),
                 (F.col("disparate_impact") < di_threshold).alias("hit")),
        F.struct(F.lit(1).alias("ord"), F.lit("statistical_parity_difference").alias("metric"),
                 F.col("statistical_parity_difference").alias("value"),
                 F.lit(spd_threshold).alias("threshold"),
                 (F.col("statistical_parity_difference") > spd_threshold).alias("hit")))).alias("r"))
    return long.where(F.coalesce(F.col("r.hit"), F.lit(False))).select(
        "sensitive_feature", F.col("r.ord").alias("alert_order"), F.col("r.metric").alias("metric"),
        F.col("r.value").alias("value"), F.col("r.threshold").alias("threshold"))


def _num(c):
    """A number as JSON text with six decimals."""
    return F.coalesce(c.cast("decimal(18,6)").cast("string"), F.lit("null"))


def alert_snapshot(rates: DataFrame, disp: DataFrame, alerts: DataFrame) -> DataFrame:
    """A11 payload: per attribute, JSON of the metrics and of the alert reasons.

    Only attributes with at least one alert produce a row (an event). ``event_key`` is the
    hash of what the event says: a run that finds the same again has the same key and is not appended twice.
    """
    by_group = rates.groupBy("sensitive_feature").agg(
        F.array_sort(F.collect_list(F.struct("group_value", "selection_rate"))).alias("by_group"),
        F.first("overall_selection_rate").alias("overall_selection_rate"))
    reasons = alerts.groupBy("sensitive_feature").agg(
        F.array_sort(F.collect_list(F.struct("alert_order", "metric", "value", "threshold")))
        .alias("_r"))
    j = reasons.join(by_group, "sensitive_feature")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    groups = F.array_join(F.transform("by_group", lambda g: F.concat(quoted(g["group_value"]), F.lit(":"), _num(g["selection_rate"]))), ",")
    snapshot = F.concat(F.lit('{"available":true,"sensitive_feature":'), quoted(F.col("sensitive_feature")),
                        F.lit(',"overall_selection_rate":'), _num(F.col("overall_selection_rate")),
                        F.lit(',"by_group":{'), groups, F.lit("}}"))
    details = F.concat(F.lit('{"alerts":['), F.array_join(F.transform("_r", lambda x: F.concat(
        F.lit('{"metric":'), quoted(x["metric"]), F.lit(',"value":'), _num(x["value"]), F.lit(',"threshold":'), _num(x["threshold"]),
        F.lit("}"))), ","), F.lit("]}"))
    return j.select("sensitive_feature", F.lit("bias-alert").alias("event_type"),
                    snapshot.alias("fairness_snapshot"), details.alias("details")) \
        .withColumn("event_key", F.sha2(F.concat_ws("|", "sensitive_feature", "fairness_snapshot", "details"), 256))


def label_from_class(col: str = "class", positive: str = "good"):
    """Text target -> 0/1 label."""
    return (F.col(col) == F.lit(positive)).cast("int")


def dataset_fairness(df: DataFrame, score, target: str = "class", threshold: float = 0.5,
                     candidates: Sequence[str] = SENSITIVE_CANDIDATES) -> tuple[dict, DataFrame | None]:
    """Fairness of a scored dataset with a text target (credit-g flow: S14, P4, P5, A5-A7).

    ``score`` is a Column with the positive-class probability. Returns
    ({available, reason, sensitive_feature}, selection-rate DataFrame or None);
    all checks are on the schema, so nothing runs until the rates are used.
    """
    if target not in df.columns:
        return {"available": False, "reason": f"No '{target}' column in dataset"}, None
    attr = pick_sensitive(df, candidates)
    if attr is None:
        return {"available": False, "reason": "No suitable sensitive attribute found"}, None
    pred = df.select(label_from_class(target).alias("y_true"),
                     (score >= threshold).cast("int").alias("y_pred"), F.col(attr))
    return {"available": True, "reason": None, "sensitive_feature": attr}, selection_rates(pred, [attr], "y_pred")
