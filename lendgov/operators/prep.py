"""Model preparation: imputation, standardisation, one-hot encoding, stratified split (M1-M4, M8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import multi_quantiles


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows dealt evenly over tasks, for work that costs far more than moving a row.

    A compact table is read by a few tasks however much work its rows are. Several tasks for each core, and no fewer than the shuffle
    partitions that the session is sized by. Given the number of ``rows``, one task for each core, and none for less than ``SPREAD_ROWS``
    rows: what each task of a fit holds and sends (statistics of all nodes) grows with the number of tasks.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows is None:
        return df.repartition(max(SPREAD_TASKS * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tasks = min(cores, -(-rows // SPREAD_ROWS))
    return df.repartition(tasks) if tasks > 1 else df


#: Tasks for each core, and the rows for which a task of a fit is worth it.
SPREAD_TASKS, SPREAD_ROWS = 4, 20_000


def split_by_dtype(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical column names from the schema (no job)."""
    from pyspark.sql.types import NumericType
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]
    cat = [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType) and f.name not in exclude]
    return num, cat


def medians(df: DataFrame, cols: Sequence[str], accuracy: int = 10000) -> DataFrame:
    """One row of exact medians, ``med_<c>``."""
    return multi_quantiles(df, [(c, 0.5, f"med_{c}") for c in cols], accuracy=accuracy)


def impute_median(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """M1: nulls take the exact column median (one-row stats broadcast back)."""
    m = medians(df, cols)
    j = df.crossJoin(F.broadcast(m))
    return j.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.col(f"med_{c}")).alias(c) for c in cols])


def standardize(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """M2: (x - mean) / population std; a zero std counts as 1."""
    st = df.agg(*[F.avg(c).alias(f"mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(st))
    out = []
    for c in cols:
        sd = F.when(F.col(f"sd_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"sd_{c}"))
        out.append(((F.col(c) - F.col(f"mu_{c}")) / sd).alias(c))
    return j.select(*keys, *out)


def _mode_best(counts: DataFrame) -> DataFrame:
    # ties -> smallest value; a partial aggregate, so a column with many distinct values fills no task
    top = counts.groupBy("column_name").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), "column_name").where("n = top").groupBy("column_name").agg(
        F.min("value").alias("value"), F.max("n").alias("n"))


def impute_mode(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """M3: nulls take the column mode (ties -> smallest)."""
    m = mode_table(df, cols)
    wide = m.groupBy().pivot("column_name", list(cols)).agg(F.first("mode_value"))
    j = df.crossJoin(F.broadcast(wide.select(*[F.col(c).alias(f"mode_{c}") for c in cols])))
    return j.select(*keys, *[F.coalesce(F.col(c).cast("string"), F.col(f"mode_{c}")).cast(df.schema[c].dataType)
                             .alias(c) for c in cols])


def mode_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                                for c in cols]))
    counts = df.select(pairs.alias("p")).where(F.col("p.v").isNotNull()) \
        .groupBy(F.col("p.k").alias("column_name"), F.col("p.v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return _mode_best(counts).select("column_name", F.col("value").alias("mode_value"), "n")


# The categories of the loan dataset's categorical features, sorted.
CATEGORY_DOMAINS = {"Gender": ["Female", "Male"], "Married": ["No", "Yes"], "Dependents": ["0", "1", "2", "3+"],
                    "Education": ["Graduate", "Not Graduate"], "Self_Employed": ["No", "Yes"],
                    "Property_Area": ["Rural", "Semiurban", "Urban"], "Credit_History": ["0", "1"]}


def one_hot(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
            domains: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """M4: one 0/1 column per (feature, category), categories sorted; unseen -> all zero.

    The categories are a declared domain (one output column each), so encoding is
    one projection and no label travels to the driver.
    """
    domains = domains or CATEGORY_DOMAINS
    return df.select(*keys, *[F.when(F.col(c).cast("string") == lab, 1).otherwise(0).alias(onehot_name(c, lab))
                              for c in cols for lab in domains[c]])


def onehot_name(col: str, label: str) -> str:
    return col + "_" + "".join(ch if ch.isalnum() else "_" for ch in str(label))


# Fixed multiplier of the split hash (odd, so id -> hash is a bijection mod 2^32).
SPLIT_MULT = 2654435761
SPLIT_MOD = 4294967296


def split_hash(id_col: str):
    """(id * SPLIT_MULT) mod 2^32, multiplied in two halves so that no id overflows 64 bits."""
    low = F.pmod(F.col(id_col), F.lit(SPLIT_MOD))
    high = F.shiftright(low, 16) * F.lit(SPLIT_MULT) % F.lit(1 << 16) * F.lit(1 << 16)
    return (high + low.bitwiseAND(F.lit((1 << 16) - 1)) * F.lit(SPLIT_MULT)) % F.lit(SPLIT_MOD)


def split_hash_sql(id_col: str) -> str:
    low = f"(({id_col} % {SPLIT_MOD} + {SPLIT_MOD}) % {SPLIT_MOD})"
    return f"(({low} // 65536 * {SPLIT_MULT} % 65536 * 65536 + {low} % 65536 * {SPLIT_MULT}) % {SPLIT_MOD})"


def stratified_split(df: DataFrame, id_col: str, label: str, test_fraction: float = 0.2,
                     bucket_bits: int = 20) -> DataFrame:
    """M8: deterministic stratified split; per class the ceil(f * n) smallest hashes are test.

    A class can hold half the table, so there is no window over a class:
    hashes are counted per (class, bucket) (bounded table), a running count
    finds each class's boundary bucket, and only rows in that one bucket are
    ranked. Adds ``is_test``.
    """
    shift = 32 - bucket_bits
    h = df.withColumn("_h", split_hash(id_col)).withColumn("_b", F.shiftright("_h", shift))
    counts = h.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    wt = Window.partitionBy(label)
    cum = counts.select(label, "_b", "_c", F.sum("_c").over(w).alias("_cum"), F.sum("_c").over(wt).alias("_n"))
    cum = cum.withColumn("_k", F.ceil(F.col("_n") * F.lit(test_fraction)))
    edge = cum.where(F.col("_cum") >= F.col("_k")).groupBy(label).agg(
        F.min_by(F.struct(F.col("_b").alias("bstar"), (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("need")),
                 F.col("_b")).alias("e"))
    edge = edge.select(label, "e.bstar", "e.need")
    j = h.join(F.broadcast(edge), label, "left")  # one row per class
    inside = j.where(F.col("_b") == F.col("bstar"))
    wr = Window.partitionBy(label).orderBy("_h", id_col)
    inside = inside.withColumn("is_test", F.row_number().over(wr) <= F.col("need"))
    rest = j.where(F.col("bstar").isNull() | (F.col("_b") != F.col("bstar"))) \
        .withColumn("is_test", F.coalesce(F.col("_b") < F.col("bstar"), F.lit(False)))
    return inside.unionByName(rest).drop("_h", "_b", "bstar", "need")


def with_split(df: DataFrame, id_col: str, label: str, test_fraction: float = 0.2) -> DataFrame:
    """M8 on wide rows with distinct ids: ``is_test`` by each class's greatest test hash, so that only ids and labels are shuffled."""
    test = stratified_split(df.select(id_col, label), id_col, label, test_fraction).where("is_test")
    key = F.struct(split_hash(id_col).alias("h"), F.col(id_col).alias("id"))
    last = test.groupBy(label).agg(F.max(key).alias("_last"))
    j = df.join(F.broadcast(last), label, "left")  # one row per class
    return j.select(*df.columns, F.coalesce(key <= F.col("_last"), F.lit(False)).alias("is_test"))
