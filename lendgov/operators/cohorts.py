"""Cohort statistics for questions.

Cohort of a requested amount a: approved loans with LoanAmount in
[0.7a, 1.3a]; the whole approved table when that range is empty or no
amount was asked.

The asked ranges cut the amount axis into slots (one between each two neighbouring range ends, one at
each end). A loan lies in one slot and is never paired with amounts: loans are counted once per (slot,
statistic, value bin), and an amount adds up the counts of its slots, which are covered by a
logarithmic number of dyadic nodes, so many overlapping ranges stay cheap. A range's quartiles need
the values of the few bins that hold its ranks; only those loans are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prefix import distributed_rank

LOW, HIGH = 0.7, 1.3
#: Width of the log-scale buckets in which a loan looks up its slot.
BUCKET_WIDTH = 0.01
#: Value bins of each statistic.
BINS = 512
PROBS = [0.25, 0.5, 0.75]
# (output prefix, column) of every quartile statistic.
STATS = [("bal", "bank_balance"), ("inc", "total_income"), ("ratio", "income_to_emi_ratio"),
         ("cibil", "cibil_proxy_score"), ("mob", "mobile_usage_score"),
         ("txn", "transaction_stability_score"), ("util", "credit_utilization")]


def finite(c: str):
    """P10: +-inf and NaN -> null."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def cohort_base(dataset: DataFrame) -> DataFrame:
    """P6 + P7 + P8: numeric coercion, approved only, rows with amount and balance."""
    def number(c: str) -> Column:  # text is parsed, numbers are numbers
        return F.col(c).cast("double") if isinstance(dataset.schema[c].dataType, T.NumericType) else F.col(c).try_cast("double")

    d = dataset.withColumn("LoanAmount", number("LoanAmount")).withColumn("bank_balance", number("bank_balance"))
    if "Approved" in d.columns:
        d = d.where(F.col("Approved") == 1)
    d = d.na.drop("any", subset=["LoanAmount", "bank_balance"])
    if "total_income" not in d.columns:
        d = d.withColumn("total_income", F.col("ApplicantIncome").cast("double") +
                         F.col("CoapplicantIncome").cast("double"))
    return d.withColumn("income_to_emi_ratio", finite("income_to_emi_ratio")) \
            .withColumn("credit_utilization", finite("credit_utilization"))


def _bucket(x: Column) -> Column:
    return F.floor(F.log(x) / F.lit(BUCKET_WIDTH))


def _ends(amounts: DataFrame) -> DataFrame:
    """Distinct range ends in order: (end, place from 0). One row per end of a distinct amount."""
    ends = amounts.select(F.explode(F.array(F.col("amount") * LOW, F.col("amount") * HIGH)).alias("end")).distinct()
    return distributed_rank(ends.withColumn("_one", F.lit(0)), ["_one"], ["end"], "place").drop("_one").withColumn("place", F.col("place") - 1)


def with_slot(base: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds ``slot``: 2 * (ends below the loan's amount), plus 1 if the amount is itself an end.

    Loans meet the ends of their log-scale bucket; for the buckets between, the place of the next lower end is
    carried. A loan finds one bucket row, so no loan is multiplied.
    """
    by_bucket = ends.groupBy(_bucket(F.col("end")).alias("bk")).agg(
        F.array_sort(F.collect_list("end")).alias("here"), F.min("place").alias("below"))
    span = by_bucket.agg(F.min("bk").alias("lo"), F.max("bk").alias("hi"), F.sum(F.size("here")).alias("n"))
    b = base.withColumn("_bk", F.when(F.col("LoanAmount") > 0, _bucket(F.col("LoanAmount"))))
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("bk"), "n")
    up = Window.orderBy("bk").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = every.join(by_bucket, "bk", "left").select(
        F.col("bk").alias("_b"), "here", F.coalesce("below", F.min("below").over(up), F.col("n")).alias("below"))
    j = b.join(filled, F.col("_bk") == F.col("_b"), "left").crossJoin(F.broadcast(span))  # span: one row
    x = F.col("LoanAmount")
    here = F.coalesce(F.col("here"), F.array().cast("array<double>"))
    inside = F.col("below") + F.size(F.filter(here, lambda e: e < x))
    outside = F.when(F.col("_bk") > F.col("hi"), F.col("n")).otherwise(F.lit(0))
    exact = F.array_contains(here, x).cast("int")
    slot = F.when(F.col("_b").isNull(), outside * 2).otherwise(inside * 2 + exact)
    return j.withColumn("slot", F.coalesce(slot, F.lit(0)).cast("bigint")).select(*base.columns, "slot")


def _size(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level)


def _nodes(lo: Column, hi: Column, levels: int) -> Column:
    """The dyadic nodes (level, node) that cover the slots lo..hi without overlap."""
    def at(k: Column) -> Column:
        size = _size(k)
        left = F.floor((lo + size - 1) / size).cast("bigint")
        right = F.floor((hi + 1) / size).cast("bigint") - 1
        some = left <= right
        return F.array_compact(F.array(F.when(some & (left % 2 == 1), F.struct(k.alias("level"), left.alias("node"))),
                                       F.when(some & (right % 2 == 0), F.struct(k.alias("level"), right.alias("node")))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def _up(df: DataFrame, levels: int) -> DataFrame:
    """Each row once for every node above its slot; the topmost node is everything."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")) \
        .withColumn("node", F.call_function("shiftright", F.col("slot"), F.col("level"))).drop("slot")


def _ranges(amounts: DataFrame, ends: DataFrame, levels: int) -> DataFrame:
    """(amount, level, node): the nodes of every asked range, and of the whole table for the null amount."""
    # an end that equals an amount's bound gives the bound's own slot
    lo, hi = ends.select(F.col("end").alias("lo_end"), F.col("place").alias("lo")), ends.select(F.col("end").alias("hi_end"), F.col("place").alias("hi"))
    asked = amounts.join(lo, F.col("amount") * LOW == F.col("lo_end")).join(hi, F.col("amount") * HIGH == F.col("hi_end"))
    nodes = asked.select("amount", F.explode(_nodes(F.col("lo") * 2 + 1, F.col("hi") * 2 + 1, levels)).alias("n")).select("amount", "n.level", "n.node")
    whole = amounts.sparkSession.range(1).select(F.lit(None).cast("double").alias("amount"), F.lit(levels).alias("level"), F.lit(0).cast("bigint").alias("node"))
    return nodes.unionByName(whole)


def _values(base: DataFrame, stats: list[tuple[str, str]]) -> DataFrame:
    """(slot, stat, v): one row for each value of the chosen statistics."""
    pairs = F.array(*[F.struct(F.lit(i).alias("stat"), F.col(c).cast("double").alias("v")) for i, (_, c) in enumerate(stats)])
    return base.select("slot", F.explode(pairs).alias("p")).select("slot", "p.stat", "p.v").where("v is not null")


def _with_bin(values: DataFrame, base: DataFrame, stats: list[tuple[str, str]]) -> DataFrame:
    """Adds the value's bin between the statistic's least and greatest value, finer towards the low half
    of a long tail. Bins only order the values; limits and middle are one-row aggregates."""
    each = [F.col(c).cast("double") for _, c in stats]
    ext = base.agg(F.array(*map(F.min, each)).alias("least"), F.array(*map(F.max, each)).alias("most"),
                   F.array(*[F.percentile_approx(c, 0.5, 100) for c in each]).alias("middle"))
    lo, hi, mid = (F.element_at(x, F.col("stat") + 1) for x in ("least", "most", "middle"))
    unit = F.when(mid > lo, mid - lo).otherwise(hi - lo)
    b = F.when(hi > lo, F.least(F.floor(F.log1p((F.col("v") - lo) / unit) / F.log1p((hi - lo) / unit) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    return values.crossJoin(F.broadcast(ext)).withColumn("bin", b.cast("int")).drop("least", "most", "middle")


def _quartiles(ranges: DataFrame, base: DataFrame, stats: list[tuple[str, str]], levels: int) -> DataFrame:
    """Exact quartiles of each statistic per amount: counts per bin first, then the values of the bins that hold a rank."""
    binned = _with_bin(_values(base, stats), base, stats)
    counts = binned.groupBy("slot", "stat", "bin").agg(F.count(F.lit(1)).alias("n"))
    per = _up(counts, levels).join(ranges, ["level", "node"]).groupBy("amount", "stat", "bin").agg(F.sum("n").alias("n"))
    # at most BINS rows per amount and statistic
    w = Window.partitionBy("amount", "stat")
    run = per.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    before = F.col("upto") - F.col("n")
    ranks = [(p, f((F.col("total") - 1) * F.lit(p)).cast("bigint")) for p in PROBS for f in (F.floor, F.ceil)]
    held = F.array_compact(F.array(*[F.when((r >= before) & (r < F.col("upto")), F.struct(F.lit(p).alias("p"), r.alias("rank"))) for p, r in ranks]))
    wanted = run.select("amount", "stat", "bin", before.alias("before"), "total", F.explode(F.array_distinct(held)).alias("r")) \
        .select("amount", "stat", "bin", "before", "total", "r.p", "r.rank").checkpoint()
    # the second look: loans in a wanted bin reach the amounts through their nodes and are counted per value
    bins = wanted.select("stat", "bin").distinct()
    again = binned.join(F.broadcast(bins), ["stat", "bin"], "left_semi")  # at most BINS rows a statistic
    need = wanted.select("amount", "stat", "bin").distinct().join(ranges.withColumnRenamed("amount", "_a"), F.col("amount").eqNullSafe(F.col("_a"))).drop("_a")
    found = _up(again, levels).join(need, ["level", "node", "stat", "bin"]).groupBy("amount", "stat", "bin", "v").agg(F.count(F.lit(1)).alias("n"))
    inner = Window.partitionBy("amount", "stat", "bin").orderBy("v")
    found = found.withColumn("in_bin", F.sum("n").over(inner))
    j = wanted.withColumnRenamed("amount", "_a").join(
        found.withColumnRenamed("stat", "_s").withColumnRenamed("bin", "_b"),
        F.col("_a").eqNullSafe(F.col("amount")) & (F.col("stat") == F.col("_s")) & (F.col("bin") == F.col("_b"))
        & (F.col("rank") < F.col("before") + F.col("in_bin")) & (F.col("rank") >= F.col("before") + F.col("in_bin") - F.col("n")))
    pos = (F.col("total") - 1) * F.col("p")
    at = j.groupBy("_a", "stat", "p").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(pos - F.floor(pos)).alias("part"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return at.groupBy(F.col("_a").alias("amount")).agg(*[
        F.max(F.when((F.col("stat") == i) & (F.col("p") == p), value)).alias(f"{pre}_q{int(p * 100)}")
        for i, (pre, _) in enumerate(stats) for p in PROBS])


def cohort_stats(amounts: DataFrame, base: DataFrame, which=None) -> DataFrame:
    """Per distinct amount (and one row with a null amount for 'no amount'): stats + fallback flag.

    Amounts whose range holds no loan take the whole-table row (P9); an amount of 0 or less has no range.
    """
    chosen = [(pre, c) for pre, c in STATS if which is None or pre in which]
    amounts = amounts.where(F.col("amount").isNotNull()).select("amount").distinct()
    # each of these is read several times: written once to the shared folder
    amounts = amounts.checkpoint()
    ends = _ends(amounts).checkpoint()
    slotted = with_slot(base.select("LoanAmount", "Credit_History", *[c for _, c in chosen]), ends).checkpoint()
    levels = (2 * ends.count() + 2).bit_length()  # depth of the dyadic tree over the slots
    ranges = _ranges(amounts, ends, levels).checkpoint()
    rows = slotted.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("Credit_History") == 1).alias("good"))
    per = _up(rows, levels).join(ranges, ["level", "node"]) \
        .groupBy("amount").agg(F.sum("n").alias("cohort_rows"), (F.sum("good") / F.greatest(F.sum("n"), F.lit(1))).alias("good_share"))
    if chosen:
        q = _quartiles(ranges, slotted, chosen, levels).withColumnRenamed("amount", "_a")
        per = per.join(q, F.col("amount").eqNullSafe(F.col("_a")), "left").drop("_a")
    per = per.checkpoint()
    cols = [c for c in per.columns if c != "amount"]
    # no loans at all: one row with nothing in it
    none = amounts.sparkSession.range(1).select(F.lit(None).cast("double").alias("_x"))
    whole = none.join(per.where(F.col("amount").isNull()), F.lit(True), "left").select(
        *[F.coalesce(F.col(c), F.lit(0)).alias(f"_g_{c}") if c == "cohort_rows" else F.col(c).alias(f"_g_{c}") for c in cols])
    found = amounts.join(per.where(F.col("amount").isNotNull()), "amount", "left")
    fallback = F.col("cohort_rows").isNull()
    out = found.crossJoin(F.broadcast(whole)).select(
        "amount", fallback.alias("uses_fallback"), *[F.when(fallback, F.col(f"_g_{c}")).otherwise(F.col(c)).alias(c) for c in cols])
    return out.unionByName(whole.select(F.lit(None).cast("double").alias("amount"), F.lit(False).alias("uses_fallback"),
                                        *[F.col(f"_g_{c}").alias(c) for c in cols]))
