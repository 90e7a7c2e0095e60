"""Free-form requests (P2, P13, P14, H1, X9): features that arrive as any JSON object.

A body is parsed once into a VARIANT. Its text form is canonical by construction: a variant keeps an object's keys in byte
order at every depth, numbers in their shortest form, and no white space, so that two bodies that say the same have the same hash.
A key that is present with null is not the same as a key that is absent: only the latter takes a default.
A body that is not a JSON object (malformed, a list, a key given twice, none at all) is marked, not an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as FX
from ..functions.hashing import sha256

#: What a body holds where the service names a feature, and the types it is read as.
TEXT_FEATURES = ("Gender", "Married", "Dependents", "Education", "Self_Employed", "Property_Area")
ENGINEERED = ("total_income", "emi", "income_to_emi_ratio", "credit_utilization", "stability_score", "cibil_proxy_score")


def parsed(df: DataFrame, body: str = "body", out: str = "request") -> DataFrame:
    """``df`` with the VARIANT of its body; null where the body is not an object."""
    v = F.try_parse_json(body)
    return df.withColumn(out, F.when(F.expr(f"schema_of_variant(try_parse_json({body})) like 'OBJECT<%'"), v))


def _at(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def present(request: str, key: str) -> Column:
    """Whether the request has the key, with whatever value (null included)."""
    return F.coalesce(F.variant_get(F.col(request), _at(key), "variant").isNotNull(), F.lit(False))


def value(request: str, key: str, kind: str = "double") -> Column:
    """The key's value; null where it is absent, null, or not of the kind."""
    return F.try_variant_get(F.col(request), _at(key), kind)


def canonical(request: str) -> Column:
    """The request as text with sorted keys at every depth."""
    return F.to_json(F.col(request))


def request_hash(request: str) -> Column:
    """H1: SHA-256 of the canonical text; null where there is no request."""
    return sha256(canonical(request))


def project(df: DataFrame, keys: Sequence[str], request: str = "request", features: Sequence[str] = tuple(FX.MODEL_FEATURES)) -> DataFrame:
    """``keys`` and the features in their order; an absent one is null."""
    return df.select(*keys, *[value(request, f, "string" if f in TEXT_FEATURES else "double").alias(f) for f in features])


def served(df: DataFrame, keys: Sequence[str], request: str = "request") -> DataFrame:
    """P13 + P14: the serving features of each request. What the caller gives wins over what is computed, a given null too."""
    raw = [f for f in FX.MODEL_FEATURES if f not in ENGINEERED] + ["bank_balance"]
    given = df.select(*keys, *[value(request, f, "string" if f in TEXT_FEATURES else "double").alias(f) for f in dict.fromkeys(raw)],
                      *[F.struct(present(request, f).alias("is"), value(request, f).alias("as")).alias(f"given_{f}") for f in ENGINEERED])
    computed = FX.with_serve_features(given)
    return computed.select(*[c for c in computed.columns if c not in ENGINEERED and not c.startswith("given_")],
                           *[F.when(F.col(f"given_{f}")["is"], F.col(f"given_{f}")["as"]).otherwise(F.col(f)).alias(f) for f in ENGINEERED])
