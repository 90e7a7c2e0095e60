"""Derived loan tables that follow a growing folder of application files without a rebuild.

Each input file is read once. What is kept of it: its features, and per numeric column an exact histogram over order-preserving
bins with each bin's extremes. Histograms of files add up, so after new files only those are read, and the merged
histogram says exactly which bin holds a quantile's rank; the rows of that bin, found by their values, give the exact order statistic.
Extremes merge likewise. Scores are then a projection of the kept features with the merged numbers; the result is that of a full build.

A file that is gone or has changed is another file: its old part is left out from then on. New files are taken in by one job, whose output is
partitioned by file; a file counts as taken in once the index names it, and a refresh that was broken off before overwrites what it left.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as FX
from .materialize import _files, _fs

#: Bins for each doubling of a value.
FINENESS = 256
_ZERO = 300_000  # above all scaled logarithms of doubles

#: The columns that scores need statistics of.
COLUMNS = ("total_income", "income_to_emi_ratio", "bank_balance")


def value_bin(x: Column) -> Column:
    """A number that rises with the value: equal values share it, and so do values within a factor of 2^(1/FINENESS)."""
    size = F.floor(F.log2(F.abs(x)) * FINENESS) + _ZERO
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("bigint")


def _plain(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


class AppendedTable:
    """``source``: a folder of Parquet files; ``store``: a folder in shared storage; ``derive`` maps a file's rows to what is kept of them."""

    def __init__(self, spark: SparkSession, source: str, store: str, derive: Callable[[DataFrame], DataFrame], columns: Sequence[str] = COLUMNS):
        self.spark, self.source, self.store, self.derive, self.columns = spark, source, store, derive, list(columns)

    def _source_files(self) -> dict[str, str]:
        """Key (path, length and time) -> path of every data file there is."""
        fs, root = _fs(self.spark, self.source)
        return {"f" + hashlib.sha256(line.encode()).hexdigest()[:20]: line.rsplit("|", 2)[0] for line in _files(fs, root)}

    def _path(self, kind: str) -> str:
        return os.path.join(self.store, kind)

    def _indexed(self) -> set[str]:
        fs, p = _fs(self.spark, self._path("index"))
        return {r["file"] for r in self.spark.read.schema("file string").parquet(self._path("index")).collect()} if fs.exists(p) else set()

    def refresh(self) -> list[str]:
        """Take in the files that are new; returns the paths that were read. (File names are on the driver as in any listing, rows are not.)"""
        files, known = self._source_files(), self._indexed()
        new = {k: p for k, p in files.items() if k not in known}
        if new:
            names = self.spark.createDataFrame([(_plain(p), k) for k, p in new.items()], "_path string, file string")
            escaped = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/"), r"\+", "%2B")
            path = F.url_decode(escaped)
            kept = self.derive(self.spark.read.parquet(*new.values()).select("*", path.alias("_path")))
            self._write(kept.join(F.broadcast(names), "_path").drop("_path"), "rows")
            self._write(self._statistics(self.spark.read.parquet(self._path("rows")).where(F.col("file").isin(*new))), "stats")
            names.select("file").coalesce(1).write.mode("append").parquet(self._path("index"))
        self.stale = sorted(known - set(files))
        return sorted(new.values())

    def _write(self, df: DataFrame, kind: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(self._path(kind))

    def _statistics(self, rows: DataFrame) -> DataFrame:
        """file, column, bin, n, least, greatest."""
        each = rows.select("file", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in self.columns])).alias("v"))
        return (each.select("file", "v.*").where("x is not null").groupBy("file", "column", value_bin(F.col("x")).alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest")))

    def _read(self, kind: str) -> DataFrame:
        """The parts of the files that are there, by the last refresh."""
        parts = self.spark.read.option("basePath", self._path(kind)).parquet(self._path(kind))
        parts = parts.withColumn("file", F.col("file").cast("string"))
        return parts.where(~F.col("file").isin(*self.stale)) if self.stale else parts

    @property
    def rows(self) -> DataFrame:
        """What is kept of all files."""
        return self._read("rows").drop("file")

    def merged(self) -> DataFrame:
        """column, bin, n, least, greatest, before (rows of lower bins) and total over all files."""
        m = self._read("stats").groupBy("column", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
        w = Window.partitionBy("column").orderBy("bin")  # bins, not rows
        return m.withColumns({"before": F.sum("n").over(w) - F.col("n"), "total": F.sum("n").over(Window.partitionBy("column"))})

    def maximum(self, column: str, name: str) -> DataFrame:
        return self.merged().where(F.col("column") == column).agg(F.max("greatest").alias(name))

    def quantiles(self, specs: Sequence[tuple[str, float, str]]) -> DataFrame:
        """One row: exact (column, prob, name) quantiles with linear interpolation, from the merged histogram and the rows of the bins that hold the ranks."""
        merged = self.merged().checkpoint()
        wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(c).alias("c"), F.lit(float(p)).alias("p")) for i, (c, p, _) in enumerate(specs)]))
        totals = merged.groupBy("column").agg(F.max("total").alias("total")).select("column", "total", wanted.alias("s")).where("column = s.c")
        at = totals.select("s.spec", "column", "total", (F.col("s.p") * (F.col("total") - 1)).alias("pos"))
        ranks = at.select("spec", "column", "pos", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("rank"))
        held = (ranks.join(merged.drop("total"), "column").where("before <= rank and rank < before + n")
                .select("spec", "column", "pos", "rank", (F.col("rank") - F.col("before")).alias("nth"), "least", "greatest")).checkpoint()
        rows = self.rows
        found = []
        for c in dict.fromkeys(c for c, _, _ in specs):
            spans = held.where(F.col("column") == c).select("least", "greatest").distinct().collect()  # two bins a quantile at most
            near = reduce(lambda a, b: a | b, [F.col(c).between(s["least"], s["greatest"]) for s in spans]) if spans else F.lit(False)
            found.append(rows.where(near).select(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")))
        values = reduce(DataFrame.unionByName, found).groupBy("column", "x").agg(F.count(F.lit(1)).alias("m"))
        inside = held.join(values, "column").where("x between least and greatest")
        upto = F.sum("m").over(Window.partitionBy("spec", "rank").orderBy("x"))
        exact = inside.withColumn("upto", upto).where("upto - m <= nth and nth < upto").groupBy("spec").agg(
            F.max_by("x", -F.col("rank")).alias("low"), F.max_by("x", "rank").alias("high"), F.first("pos").alias("pos"))
        value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("pos") - F.floor("pos"))
        return exact.groupBy().agg(*[F.max(F.when(F.col("spec") == i, value)).alias(n) for i, (_, _, n) in enumerate(specs)])


class AppendedLoans(AppendedTable):
    """Loan applications with their engineered features; scores follow the files that are there."""

    def __init__(self, spark: SparkSession, source: str, store: str):
        super().__init__(spark, source, store, FX.with_train_features)

    def scored(self) -> DataFrame:
        """F6 + F8 + F9: every application with risk score, probability, decision and label, as a full build gives them."""
        stats = self.maximum("total_income", "max_income").crossJoin(
            self.quantiles([("income_to_emi_ratio", 0.9, "q_ratio"), ("bank_balance", 0.9, "q_bal")])).checkpoint()  # one row
        return FX.with_risk(self.rows, stats=stats)
