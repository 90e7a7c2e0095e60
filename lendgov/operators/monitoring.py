"""Decision monitoring: totals, rates, daily volume, recent decisions, risk buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fixed

# Fixed bucket labels, in display order, with lower probability bounds.
RISK_BUCKETS = [("Low Risk (High Prob)", 0.7), ("Medium Risk", 0.3), ("High Risk (Low Prob)", None)]


def summary(decisions: DataFrame) -> DataFrame:
    """A1 + A2 in one pass: totals and rates in percent (0 when empty)."""
    agg = decisions.agg(F.count(F.lit(1)).alias("total"),
                        F.count_if(F.col("decision") == "approved").alias("approvals"),
                        F.count_if(F.col("decision") == "denied").alias("denials"))
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    return agg.select("total", "approvals", "denials", rate("approvals").alias("approval_rate"),
                      rate("denials").alias("denial_rate"))


def latest_ts(decisions: DataFrame, ts: str = "ts"):
    """Largest timestamp, fetched as one scalar so later filters are literals."""
    return decisions.agg(F.max(ts)).first()[0]


def daily_volume(decisions: DataFrame, days: int = 7, as_of: dt.datetime | None = None,
                 ts: str = "ts") -> DataFrame:
    """A3 + P12: counts per UTC date over the trailing window ``[as_of - days, ...]``.

    ``as_of`` defaults to the latest decision. The cutoff is a literal, so it
    reaches the scan as a pushed filter (and prunes date partitions).
    """
    if as_of is None:
        as_of = latest_ts(decisions, ts)
    if as_of is None:
        return decisions.sparkSession.createDataFrame([], "day DATE, n BIGINT")
    since = as_of - dt.timedelta(days=days)
    # at most days + 1 rows: ordered in one partition (no range-sampling job)
    return decisions.where(F.col(ts) >= F.lit(since)).groupBy(F.to_date(ts).alias("day")) \
        .agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions("day")


def iso_text(ts: str):
    """ISO-8601 text; the fraction is printed only when non-zero."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))


def recent(decisions: DataFrame, limit: int = 10, ts: str = "ts", id_col: str = "id") -> DataFrame:
    """W5 + X12 + X13: newest decisions (id breaks timestamp ties), with display text."""
    p = F.coalesce(F.col("probability").cast("double"), F.lit(0.0))
    top = decisions.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(limit)
    return top.select(
        F.col(id_col).alias("id"), iso_text(ts).alias("timestamp"), "decision",
        p.alias("probability"), "model_version",
        F.when(F.col("decision") == "approved", F.lit("✅ Approved")).otherwise(F.lit("❌ Denied"))
        .alias("outcome"),
        fixed(p, 2).alias("score_text"), F.date_format(ts, "HH:mm").alias("time_text"))


def risk_bucket(p, numeric: bool = False):
    """A4 bucket index of one probability given as text, or as a number (``numeric``).

    Null or empty -> 0.0 (High); unparsable text -> null (skipped); NaN -> High.
    """
    if numeric:
        parsed = F.coalesce(p.cast("double"), F.lit(0.0))
    else:
        s = p.cast("string")
        txt = F.trim(s)
        parsed = F.when(s.isNull() | (s == ""), F.lit(0.0)).otherwise(
            F.when(F.lower(txt).isin("nan", "+nan", "-nan"), F.lit(float("nan")))
            .otherwise(txt.try_cast("double")))
    return (F.when(parsed.isNull(), F.lit(None))
            .when(F.isnan(parsed), F.lit(2))
            .when(parsed >= 0.7, F.lit(0))
            .when(parsed >= 0.3, F.lit(1))
            .otherwise(F.lit(2)))


def _bucket_of(decisions: DataFrame, p_col: str):
    return risk_bucket(F.col(p_col), isinstance(decisions.schema[p_col].dataType, T.NumericType))


def risk_distribution(decisions: DataFrame, p_col: str = "probability") -> DataFrame:
    """A4: counts per bucket in fixed order; empty buckets omitted."""
    labels = F.array(*[F.lit(b[0]) for b in RISK_BUCKETS])
    b = decisions.select(_bucket_of(decisions, p_col).alias("bucket")).where(F.col("bucket").isNotNull())
    g = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # three rows at most: ordered in one partition
    return g.select(F.col("bucket").alias("bucket_order"),
                    F.element_at(labels, F.col("bucket") + 1).alias("category"), "n") \
        .coalesce(1).sortWithinPartitions("bucket_order")


def dashboard(decisions: DataFrame, days: int = 7, limit: int = 10,
              as_of: dt.datetime | None = None) -> DataFrame:
    """Summary, volume, recent and risk sections as typed long-form rows.

    Columns: section, item, label, n (BIGINT), value (DOUBLE).
    """
    none_s, none_n, none_v = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("double")
    if as_of is None:
        as_of = latest_ts(decisions)
    # one pass: counts per day, risk bucket, decision and side of the window's start
    inside = F.lit(False) if as_of is None else F.coalesce(F.col("ts") >= F.lit(as_of - dt.timedelta(days=days)), F.lit(False))
    counts = decisions.groupBy(F.when(inside, F.to_date("ts")).alias("day"), _bucket_of(decisions, "probability").alias("bucket"), "decision") \
        .agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    of = lambda d: F.coalesce(F.sum(F.when(F.col("decision") == d, F.col("n"))), F.lit(0))
    s = counts.agg(total.alias("total"), of("approved").alias("approvals"), of("denied").alias("denials"))
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    labels = F.array(*[F.lit(b[0]) for b in RISK_BUCKETS])
    parts = [
        s.select(F.explode(F.array(
            *[F.struct(F.lit(k).alias("item"), F.col(k).cast("bigint").alias("n"), none_v.alias("value"))
              for k in ("total", "approvals", "denials")],
            *[F.struct(F.lit(k).alias("item"), none_n.alias("n"), rate(c).alias("value"))
              for k, c in (("approval_rate", "approvals"), ("denial_rate", "denials"))])).alias("r"))
        .select(F.lit("summary").alias("section"), F.col("r.item").alias("item"),
                none_s.alias("label"), F.col("r.n").alias("n"), F.col("r.value").alias("value")),
        counts.where("day is not null").groupBy("day").agg(F.sum("n").alias("n")).select(
            F.lit("volume").alias("section"), F.col("day").cast("string").alias("item"),
            none_s.alias("label"), F.col("n"), none_v.alias("value")),
        recent(decisions, limit).select(
            F.lit("recent").alias("section"), F.col("id").cast("string").alias("item"),
            F.col("decision").alias("label"), none_n.alias("n"), F.col("probability").alias("value")),
        counts.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).select(
            F.lit("risk").alias("section"), F.element_at(labels, F.col("bucket") + 1).alias("item"), none_s.alias("label"),
            F.col("n"), none_v.alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
