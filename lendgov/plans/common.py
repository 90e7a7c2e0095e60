"""Helpers shared by query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.derived import Views



def views(spark, sf_dir: str) -> Views:
    """Fresh lazy views per call (cheap: nothing runs until an action)."""
    return Views(spark, sf_dir)


def r6(c) -> Column:
    """Round a double to 6 decimals (oracle agreement convention)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
