"""Projection, recoding and data-quality operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import CATEGORICAL_FEATURES, MODEL_FEATURES

_NUMERIC_TYPE = {"total_income": T.LongType()}


def project_features(df: DataFrame, features: Sequence[str] = MODEL_FEATURES,
                     fill_missing: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Model feature order; absent columns filled with typed nulls (or skipped).

    Schema inspection only: no job runs to find which columns exist.
    """
    out = [F.col(k) for k in keys]
    for c in features:
        if c in df.columns:
            out.append(F.col(c))
        elif fill_missing:
            t = T.StringType() if c in CATEGORICAL_FEATURES and c != "Credit_History" else T.DoubleType()
            out.append(F.lit(None).cast(t).alias(c))
    return df.select(*out)


# UI option labels -> model categories (credit-g encodings).
CHECKING_OPTIONS = {
    "No current account": "no checking",
    "Current balance < ₹25,000": "<0",
    "₹25,000 – ₹1,00,000": "0<=X<200",
    "> ₹1,00,000": ">=200",
}
PURPOSE_OPTIONS = {
    "Home / renovation loan": "domestic appliance",
    "Education loan": "education",
    "Consumer durable loan (electronics, appliances)": "radio/TV",
    "New car loan": "new car",
    "Used car / two-wheeler loan": "used car",
    "Business / working capital loan": "business",
    "Furniture / office setup loan": "furniture/equipment",
    "Home repair / upgrade loan": "repairs",
    "Other personal loan": "other",
}
SAVINGS_OPTIONS = {
    "No savings account": "no known savings",
    "Savings < ₹25,000": "<100",
    "₹25,000 – ₹1,25,000": "100<=X<500",
    "₹1,25,000 – ₹2,50,000": "500<=X<1000",
    "> ₹2,50,000": ">=1000",
}
EMPLOYMENT_OPTIONS = {
    "Currently not employed": "unemployed",
    "< 1 year in current job": "<1",
    "1 – 4 years in current job": "1<=X<4",
    "4 – 7 years in current job": "4<=X<7",
    "> 7 years in current job": ">=7",
}
CREDIT_HISTORY_LABELS = ["Good (no major defaults)", "Weak / past defaults"]


def literal_map(mapping: dict):
    """A small fixed lookup as a map literal (no join, no broadcast needed)."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def recode(label_col, mapping: dict):
    """UI label -> model code; unknown labels give null."""
    return F.try_element_at(literal_map(mapping), label_col)


def credit_history_code(label_col):
    """A credit-history label containing 'Good' means 1, else 0."""
    return F.when(label_col.contains("Good"), F.lit(1)).otherwise(F.lit(0))


# Domain rules of the application form.
NUMERIC_DOMAINS = [
    ("ApplicantIncome", 5000, 300000),
    ("CoapplicantIncome", 0, 300000),
    ("LoanAmount", 50000, 3000000),
    ("Loan_Amount_Term", 6, 360),
    ("mobile_usage_score", 300, 950),
    ("transaction_stability_score", 300, 950),
    ("bank_balance", 0, 1000000),
]
CATEGORY_DOMAINS = [
    ("Gender", ["Male", "Female"]),
    ("Married", ["Yes", "No"]),
    ("Dependents", ["0", "1", "2", "3+"]),
    ("Education", ["Graduate", "Not Graduate"]),
    ("Self_Employed", ["No", "Yes"]),
    ("Property_Area", ["Urban", "Semiurban", "Rural"]),
    ("Credit_History", [0, 1]),
]


def domain_violations(df: DataFrame) -> DataFrame:
    """One scan; per column the count of nulls and of out-of-domain values."""
    aggs, names = [], []
    for i, (c, lo, hi) in enumerate(NUMERIC_DOMAINS):
        if c in df.columns:
            aggs += [F.count_if(F.col(c).isNull()).alias(f"n{i}"),
                     F.count_if(~F.col(c).between(lo, hi)).alias(f"v{i}")]
            names.append((i, c, "range"))
    base = len(NUMERIC_DOMAINS)
    for j, (c, allowed) in enumerate(CATEGORY_DOMAINS):
        if c in df.columns:
            k = base + j
            aggs += [F.count_if(F.col(c).isNull()).alias(f"n{k}"),
                     F.count_if(~F.col(c).isin(*allowed)).alias(f"v{k}")]
            names.append((k, c, "category"))
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule_order"), F.lit(c).alias("column_name"), F.lit(kind).alias("rule"),
                 F.col(f"n{k}").alias("n_null"), F.col(f"v{k}").alias("n_violations"))
        for k, c, kind in names]))
    return one.select(rows.alias("r")).select("r.*")
