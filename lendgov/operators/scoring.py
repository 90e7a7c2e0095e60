"""Fixed-coefficient scorecard (M14 oracle path) and the consent what-if."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import multi_quantiles

# Scorecard margin terms (input, weight, cap) and intercept.
INTERCEPT = -2.0
TERMS = [
    ("Credit_History", 1.5, None),
    ("stability_score", 1.0, None),
    ("cibil_proxy_score", 0.004, None),
    ("income_to_emi_ratio", 0.01, 50.0),
    ("credit_utilization", -0.05, 20.0),
    ("bank_balance", 0.000001, None),
]
# Model feature index of each input (ties in attribution keep this order).
FEATURE_INDEX = {"bank_balance": 6, "income_to_emi_ratio": 9, "credit_utilization": 10,
                 "stability_score": 11, "cibil_proxy_score": 12, "Credit_History": 19}


def medians(df: DataFrame, accuracy: int = 10000) -> DataFrame:
    """One row: exact median of every scorecard input (null and denied fill-in)."""
    return multi_quantiles(df, [(c, 0.5, f"med_{c}") for c, _, _ in TERMS], accuracy=accuracy)


def params(df: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Fitted scorecard parameters (one row): median of each input and mean of each
    filled, capped input (the attribution baseline)."""
    meds = medians(df, accuracy)
    filled = df.crossJoin(F.broadcast(meds)).select(
        *[capped(c, F.coalesce(F.col(c).cast("double"), F.col(f"med_{c}"))).alias(c) for c, _, _ in TERMS])
    means = filled.agg(*[F.avg(c).alias(f"mean_{c}") for c, _, _ in TERMS])
    return meds.crossJoin(means)


def capped(c: str, value):
    cap = dict((n, k) for n, _, k in TERMS)[c]
    v = value.cast("double")
    return F.least(v, F.lit(cap)) if cap is not None else v


def margin(inputs: dict):
    """Scorecard margin from a {input: Column} mapping (already filled)."""
    z = F.lit(INTERCEPT)
    for c, w, _ in TERMS:
        z = z + F.lit(w) * capped(c, inputs[c])
    return z


def sigmoid(z):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score(df: DataFrame, meds: DataFrame, allowed: dict | None = None) -> DataFrame:
    """Adds ``p_approve``; a null input, or one whose consent flag column is false, takes the median.

    ``allowed`` maps an input to the name of a boolean column (its group's flag).
    """
    meds = meds.select(*[f"med_{c}" for c, _, _ in TERMS])
    j = df.crossJoin(F.broadcast(meds))  # one row
    inputs = {}
    for c, _, _ in TERMS:
        v = F.col(c)
        if allowed and c in allowed:
            v = F.when(F.col(allowed[c]), v)
        inputs[c] = F.coalesce(v.cast("double"), F.col(f"med_{c}"))
    return j.select(*df.columns, sigmoid(margin(inputs)).alias("p_approve"))


def attribution_rows(df: DataFrame, keys: Sequence[str] = ("application_id",),
                     extra: Sequence[str] = (), fitted: DataFrame | None = None) -> DataFrame:
    """E3 (centred) per row: ``attr`` = array of (feature_idx, feature, value, shap) + ``p_approve``.

    shap = w * (x - mean(x)) on the capped inputs (nulls take the median), which
    for this linear margin under feature independence is the exact SHAP value.
    ``value`` is what the row itself holds: null where it is missing or denied, and not capped.
    Medians and means are one-row aggregates broadcast back (``fitted``: the
    stored parameters of the training table; computed from ``df`` when absent).
    """
    if fitted is None:
        fitted = params(df)
    extra = [c for c in extra if c not in keys]
    j = df.crossJoin(F.broadcast(fitted)).select(
        *keys, *[F.col(c).alias(f"_in_{c}") for c in extra],
        *[F.col(c).cast("double").alias(f"own_{c}") for c, _, _ in TERMS],
        *[capped(c, F.coalesce(F.col(c).cast("double"), F.col(f"med_{c}"))).alias(c) for c, _, _ in TERMS],
        *[F.col(f"mean_{c}") for c, _, _ in TERMS])

    def rec(c, w):
        shap = F.lit(w) * (F.col(c) - F.col(f"mean_{c}"))
        # sort key first (|shap| descending, then feature order) so the array sorts in place
        return F.struct((-F.abs(shap)).alias("sort_key"), F.lit(FEATURE_INDEX[c]).alias("feature_idx"),
                        F.lit(c).alias("feature"), F.col(f"own_{c}").alias("value"), shap.alias("shap"))

    recs = [rec(c, w) for c, w, _ in TERMS]
    z = F.lit(INTERCEPT)
    for c, w, _ in TERMS:
        z = z + F.lit(w) * F.col(c)
    return j.select(*keys, *[F.col(f"_in_{c}").alias(c) for c in extra], F.array(*recs).alias("attr"),
                    sigmoid(z).alias("p_approve"))


def attribution(df: DataFrame, keys: Sequence[str] = ("application_id",),
                fitted: DataFrame | None = None) -> DataFrame:
    """E3 in long form: one row per (row, input)."""
    rows = attribution_rows(df, keys, fitted=fitted)
    return rows.select(*keys, F.explode("attr").alias("r")).select(
        *keys, "r.feature_idx", "r.feature", "r.value", "r.shap")
