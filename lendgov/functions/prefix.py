"""Distributed running sums over a global order.

A running sum over the whole table written as a window without a partition
key runs in one task. Here the rows are range-partitioned on the order key,
each range sums locally, and a table with one row per range (bounded by the
partition count) turns local sums into global ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, order_col: str, value_cols: Sequence[str],
                 num_ranges: int | None = None, suffix: str = "_cum") -> DataFrame:
    """Adds ``<v>_cum`` = sum of ``v`` over rows with order key <= this row's key.

    ``order_col`` must be unique per row (aggregate duplicates first).
    """
    from ..session import ensure_checkpoint_dir
    n = num_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    # Range bounds come from sampling; the ranged table is written once (reliable
    # checkpoint in the shared folder) so both consumers see the same ranges.
    ranged = df.repartitionByRange(n, order_col).withColumn("_rid", F.spark_partition_id()) \
        .checkpoint(eager=True)
    w_local = Window.partitionBy("_rid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(v).over(w_local).alias(f"_l_{v}") for v in value_cols])
    totals = ranged.groupBy("_rid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    # one row per range: offsets = sum of the totals of earlier ranges
    earlier = Window.orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_rid", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    out = local.join(F.broadcast(offs), "_rid", "left")
    return out.select(*df.columns, *[(F.col(f"_l_{v}") + F.coalesce(F.col(f"_o_{v}"), F.lit(0))).alias(v + suffix)
                                     for v in value_cols])


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC-AUC with tied scores averaged (trapezoid rule); 0.0 for one class.

    Mann-Whitney form: sum over distinct scores s of pos(s) * (neg(< s) + neg(s) / 2),
    over P * N. Distinct scores are aggregated map-side first.
    """
    d = scored.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    c = running_sums(d, "s", ["neg"])
    u = c.agg(F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") + F.col("neg") / 2.0)).alias("u"),
              F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return u.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n")))
                    .otherwise(F.lit(0.0)).alias("auc"),
                    F.col("p").alias("n_pos"), F.col("n").alias("n_neg"))


def distributed_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, default,
                    out: str = "prev", num_ranges: int | None = None) -> DataFrame:
    """``lag(value, 1, default)`` over (partition by keys order by order) without a per-key task.

    Rows are range-partitioned on (keys, order), so one key may span several
    ranges; the lag is taken inside each range, and the first row of a range
    takes the last row of the previous range when it has the same key (a
    table of one row per range, broadcast). A hot key is spread over ranges
    instead of landing in one task. (keys, order) must be unique per row.
    """
    from ..session import ensure_checkpoint_dir
    n = num_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    sort_cols = list(keys) + list(order)
    ranged = df.repartitionByRange(n, *sort_cols).withColumn("_rid", F.spark_partition_id()) \
        .checkpoint(eager=True)
    w = Window.partitionBy("_rid", *keys).orderBy(*order)
    local = ranged.select("*", F.lag(value, 1).over(w).alias("_lag"),
                          F.row_number().over(w).alias("_rn"))
    key_struct = F.struct(*[F.col(k) for k in keys])
    last = ranged.groupBy("_rid").agg(F.max_by(F.struct(key_struct.alias("k"), F.col(value).alias("v")),
                                               F.struct(*sort_cols)).alias("_last"))
    prev_last = last.select((F.col("_rid") + 1).alias("_rid"), F.col("_last"))
    j = local.join(F.broadcast(prev_last), "_rid", "left")  # one row per range
    carried = F.when((F.col("_rn") == 1) & (F.col("_last.k") == key_struct), F.col("_last.v"))
    return j.select(*df.columns, F.coalesce(F.col("_lag"), carried, F.lit(default)).alias(out))


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Sequence[str], out: str | Sequence[str] = "last_known",
               num_ranges: int | None = None) -> DataFrame:
    """``last(value, ignorenulls)`` over (partition by keys order by order), up to and with the row, without a per-key task.

    ``value`` and ``out`` may be lists of the same length. As in ``distributed_lag`` a key may span several ranges; a range without a
    value before a row takes the last value of the nearest earlier range of the same key (one row per range).
    """
    from ..session import ensure_checkpoint_dir
    values, outs = ([value], [out]) if isinstance(value, str) else (list(value), list(out))
    n = num_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    sort_cols = list(keys) + list(order)
    ranged = df.repartitionByRange(n, *sort_cols).withColumn("_rid", F.spark_partition_id()).checkpoint(eager=True)
    upto = Window.partitionBy("_rid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.last(v, ignorenulls=True).over(upto).alias(f"_local{i}") for i, v in enumerate(values)])
    key = F.struct(*[F.col(k) for k in keys])
    # per range: its last key, and the last values that key has in it
    place = F.struct(*sort_cols)
    ends = ranged.groupBy("_rid").agg(F.max_by(key, place).alias("_k"))
    held = ranged.groupBy("_rid", *keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(f"_v{i}") for i, v in enumerate(values)])
    tail = ends.select("_rid", "_k").join(held.select(F.col("_rid").alias("_r"), key.alias("_vk"), *[f"_v{i}" for i in range(len(values))]),
                                          (F.col("_rid") == F.col("_r")) & F.col("_k").eqNullSafe(F.col("_vk")), "left")
    before = Window.partitionBy("_k").orderBy("_rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = tail.select((F.col("_rid") + 1).alias("_next"), "_k", *[F.last(f"_v{i}", ignorenulls=True).over(before).alias(f"_carried{i}") for i in range(len(values))])
    # a key that fills whole ranges is the last key of each of them, so the range just before carries it
    j = local.join(F.broadcast(carry), (F.col("_rid") == F.col("_next")) & key.eqNullSafe(F.col("_k")), "left")
    return j.select(*df.columns, *[F.coalesce(f"_local{i}", f"_carried{i}").alias(o) for i, o in enumerate(outs)])


def distributed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank", num_ranges: int | None = None) -> DataFrame:
    """``row_number()`` over (partition by keys order by order) without a per-key task.

    Rows are numbered inside each range; only a range's first key can have rows before it, and what it has there
    is the sum of its rows in the ranges that it ends (one row per range). (keys, order) must be unique per row.
    """
    from ..session import ensure_checkpoint_dir
    n = num_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    sort_cols = list(keys) + list(order)
    ranged = df.repartitionByRange(n, *sort_cols).withColumn("_rid", F.spark_partition_id()).checkpoint(eager=True)
    key = F.struct(*[F.col(k) for k in keys])
    local = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_rid", *keys).orderBy(*order)))
    last = local.groupBy("_rid").agg(F.max_by(F.struct(key.alias("k"), F.col("_rn").alias("n")), F.struct(*sort_cols)).alias("e"))
    upto = Window.partitionBy("_k").orderBy("_rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = last.select("_rid", F.col("e.k").alias("_k"), F.col("e.n").alias("_n")).select(
        (F.col("_rid") + 1).alias("_next"), "_k", F.sum("_n").over(upto).alias("_before"))
    j = local.join(F.broadcast(before), (F.col("_rid") == F.col("_next")) & key.eqNullSafe(F.col("_k")), "left")
    return j.select(*df.columns, (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(out))
