"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouping with map-side partial minima and a join on the vertex;
a vertex with a third of all links is a row count, not a collected list. Rounds
needed grow with the logarithm of the longest path. Every round is written to
the shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over directed links (a, b) with a > b: link neighbours of a vertex to its smallest neighbour."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                          F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every vertex of ``links`` (a, b: bigint); root is the smallest vertex reachable.

    Self links, repeated and reversed links are allowed; nulls are dropped; no links give no rows.
    """
    cur = C.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a is not null and b is not null and a <> b").distinct(), "links")
    mark = None
    while True:
        cur = C.written(_star(_star(cur, True), False), "links")
        # a star forest maps each vertex once, to a vertex that is mapped nowhere; sums tell whether a round changed it
        seen = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
