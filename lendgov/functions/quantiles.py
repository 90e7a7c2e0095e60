"""Exact quantiles that scale.

Definition: linear interpolation between closest ranks (pandas ``quantile``,
DuckDB ``quantile_cont``, Spark ``percentile``): pos = p * (n - 1), value =
x[floor(pos)] + (x[ceil(pos)] - x[floor(pos)]) * frac(pos).

Spark's exact ``percentile`` keeps a map of every distinct value of a group in
one aggregation buffer, which does not survive a hot group or a global
quantile of a continuous column at cluster scale. Here instead, for groups of every size alike:

1. ``percentile_approx`` (mergeable sketch, map-side partial aggregation)
   brackets each target rank: its rank error is at most n / accuracy, so the
   values at p -/+ 3/accuracy enclose the answer's ranks but for the rank next to either end.
2. Each further round (``rounds``) lays a grid of sketched cut points over the bracket and keeps the cells
   around the target rank. A bracket holds about 6 n / accuracy distinct values after the first round, and
   about (6 / accuracy) * (6 / GRID) * n after the second: choose the rounds for the largest group.
3. One more pass counts per distinct value inside the bracket (everything below and everything above
   collapses map-side to a count and its nearest value), so what reaches one reducer is
   bounded by the bracket, not the group. A running count picks the exact order statistics; a rank just
   outside the bracket is the nearest value below or above it.

A bracket that misses its rank by more (sketch guarantee broken) raises an error
instead of returning a wrong number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _qname(prefix: str, p: float) -> str:
    s = f"{p * 100:g}".replace(".", "_")
    return f"{prefix}_q{s}"


def quantiles(df: DataFrame, col: str, probs: Sequence[float], keys: Sequence[str] = (),
              accuracy: int = 10000, names: Sequence[str] | None = None,
              method: str = "exact") -> DataFrame:
    """Quantiles of one column per ``keys`` group; one output column per prob."""
    names = list(names) if names else [_qname(col, p) for p in probs]
    return multi_quantiles(df, [(col, float(p), n) for p, n in zip(probs, names)], keys,
                           accuracy=accuracy, method=method)


#: Cut points of a refinement round.
GRID = 1000


def _with_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Join per-group statistics to rows; a null key is a group of its own. Without keys the right side is one row per spec."""
    on = [*keys, *extra]
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in on], *[c for c in right.columns if c not in on])
    if not on:
        return left.crossJoin(F.broadcast(r))  # one row
    r = F.broadcast(r) if not keys else r  # one row for each spec
    return left.join(r, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on], "inner").drop(*[f"_k_{k}" for k in on])


def multi_quantiles(df: DataFrame, specs: Sequence[tuple[str, float, str]], keys: Sequence[str] = (),
                    accuracy: int = 10000, method: str = "exact", rounds: int = 1) -> DataFrame:
    """Several (column, prob, output name) quantiles per ``keys`` group in ``rounds + 1`` passes.

    Nulls are skipped per column. ``method="approx"`` returns the sketch
    answer directly (one pass). Returns ``keys + names``; a group appears if
    any of its columns has a value.
    """
    keys = list(keys)
    specs = [(c, float(p), n) for c, p, n in specs]
    cols = list(dict.fromkeys(c for c, _, _ in specs))
    cidx = {c: i for i, c in enumerate(cols)}
    base = df.select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])

    if method == "approx":
        aggs = [F.percentile_approx(f"_x{cidx[c]}", F.lit(p), accuracy).alias(n) for c, p, n in specs]
        return base.groupBy(*keys).agg(*aggs)

    margin = 3.0 / accuracy + 1e-12
    aggs, where = [], {}
    for i, c in enumerate(cols):
        mine = [(j, p) for j, (cc, p, _) in enumerate(specs) if cc == c]
        where.update({j: (k, k + len(mine)) for k, (j, _) in enumerate(mine)})
        edges = [max(p - margin, 0.0) for _, p in mine] + [min(p + margin, 1.0) for _, p in mine]
        aggs += [F.count(f"_x{i}").alias(f"_n{i}"),
                 F.percentile_approx(f"_x{i}", F.array(*[F.lit(e) for e in edges]), accuracy).alias(f"_a{i}")]
    joined = _with_keys(base, base.groupBy(*keys).agg(*aggs), keys)
    spec_rows = [F.struct(F.lit(j).alias("_j"), F.lit(p).alias("_p"), F.col(f"_x{cidx[c]}").alias("_x"), F.col(f"_n{cidx[c]}").alias("_n"),
                          F.col(f"_a{cidx[c]}")[where[j][0]].alias("_lo"), F.col(f"_a{cidx[c]}")[where[j][1]].alias("_hi"))
                 for j, (c, p, _) in enumerate(specs)]
    rows = joined.select(*keys, F.explode(F.array(*spec_rows)).alias("_s")).select(*keys, "_s.*").where("_x is not null")
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")

    for _ in range(rounds - 1):
        inside = F.when((x >= lo) & (x <= hi), x)
        cells = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
        seen = rows.groupBy(*keys, "_j").agg(F.count_if(x < lo).alias("_b"), F.count(inside).alias("_m"), F.percentile_approx(inside, cells, accuracy).alias("_g"))
        slack = int(3 * GRID / accuracy) + 2
        rows = _with_keys(rows, seen, keys, ["_j"])
        cell = F.floor((F.col("_p") * (F.col("_n") - 1) - F.col("_b")) / F.col("_m") * GRID)
        at = lambda k: F.element_at("_g", F.greatest(F.lit(0), F.least(F.lit(GRID), k)).cast("int") + 1)
        rows = rows.withColumns({"_lo": at(cell - slack), "_hi": at(cell + slack)}).drop("_b", "_m", "_g")

    # below and above the bracket one row each: how many, and the value nearest to it
    side = F.when(x < lo, F.lit(-1)).when(x > hi, F.lit(1)).otherwise(F.lit(0))
    counts = rows.groupBy(*keys, "_j", "_p", "_n", side.alias("_side"), F.when(side == 0, x).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("_x").alias("_top"), F.min("_x").alias("_low"))
    w = Window.partitionBy(*keys, "_j").orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_cum", F.sum("_c").over(w)).withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
    first = F.col("_cum") - F.col("_c")

    def value_at(rank):
        """The row's value if it holds this rank; of the rows outside the bracket only the nearest rank is known."""
        return F.max(F.when((F.col("_side") == 0) & (first <= rank) & (rank < F.col("_cum")), F.col("_v"))
                     .when((F.col("_side") == -1) & (rank == F.col("_cum") - 1), F.col("_top"))
                     .when((F.col("_side") == 1) & (rank == first), F.col("_low")))

    per = counts.groupBy(*keys, "_j").agg(F.first("_pos").alias("_pos"), value_at(F.floor("_pos")).alias("_vlo"), value_at(F.ceil("_pos")).alias("_vhi"))
    value = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_pos") - F.floor("_pos"))
    missed = F.raise_error(F.lit("quantile bracket missed its rank; raise accuracy")).cast("double")
    per = per.select(*keys, "_j", F.when(F.col("_vlo").isNotNull() & F.col("_vhi").isNotNull(), value).otherwise(missed).alias("_q"))
    return per.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_j") == j, F.col("_q"))).alias(n) for j, (_, _, n) in enumerate(specs)])
