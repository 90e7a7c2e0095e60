"""Attribution reasons: top features, top negative/positive, primary reason, sentence.

All per-row: attributions of one application are an array of structs sorted
in place (|shap| descending, then feature order), so no shuffle or window is
needed at any scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed

TOP_K = 5


def sorted_attr(arr):
    """Sort attribution structs, which lead with (sort_key = -|shap|, feature_idx)."""
    return F.sort_array(arr)


def zero_attribution(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("application_id",)) -> DataFrame:
    """Every feature contributes 0 (last-resort explanation), as an ``attr`` array."""
    recs = [F.struct(F.lit(i).alias("feature_idx"), F.lit(f).alias("feature"),
                     F.col(f).cast("double").alias("value"), F.lit(0.0).alias("shap"))
            for i, f in enumerate(features)]
    return df.select(*keys, F.array(*recs).alias("attr"))


def reasons(df: DataFrame, attr_col: str = "attr", k: int = TOP_K) -> DataFrame:
    """Adds top_features, top_negative, top_positive (each at most k)."""
    a = F.col(attr_col)
    return df.withColumn("top_features", F.slice(a, 1, k)) \
             .withColumn("top_negative", F.slice(F.filter(a, lambda x: x["shap"] < 0), 1, k)) \
             .withColumn("top_positive", F.slice(F.filter(a, lambda x: x["shap"] > 0), 1, k))


def value_text(v, is_text: bool = False):
    """Display text of a reason value: fixed 2 decimals (``is_text``: as it is), None where the row has none."""
    return F.coalesce(v if is_text else fixed(v, 2), F.lit("None"))


# The sentences of a decision, with and without the number.
SENTENCES = {
    True: ("supported your approval", "reduced your approval score", " based on the overall risk profile of your application."),
    False: ("supported your approval", "lowered your score the most", " based on the overall risk profile from your data."),
}


def summary(decision, with_number: bool = True, text_values: bool = False):
    """W4 + X7: sentence from the primary reason (first negative, else first positive)."""
    main = F.coalesce(F.try_element_at(F.col("top_negative"), F.lit(1)),
                      F.try_element_at(F.col("top_positive"), F.lit(1)))
    supported, reduced, overall = SENTENCES[with_number]
    direction = F.when(decision == "approved", F.lit(supported)).otherwise(F.lit(reduced))
    by = [F.lit(" by "), fixed(main["shap"], 2)] if with_number else []
    text = F.concat(F.lit("Loan "), decision, F.lit(" because "), main["feature"], F.lit(" ("), value_text(main["value"], text_values), F.lit(") "),
                    direction, *by, F.lit("."))
    fallback = F.concat(F.lit("Loan "), decision, F.lit(overall))
    return F.when(main.isNotNull(), text).otherwise(fallback)


def primary(df: DataFrame) -> DataFrame:
    main = F.coalesce(F.try_element_at(F.col("top_negative"), F.lit(1)),
                      F.try_element_at(F.col("top_positive"), F.lit(1)))
    return df.withColumn("main_feature", main["feature"]).withColumn("main_shap", main["shap"])
