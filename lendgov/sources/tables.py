"""Readers for the driver's parquet tables.

Reads are lazy; Catalyst prunes columns and pushes filters into the scan, so
callers select only what they use and the ReadSchema stays narrow.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class TableSet:
    """Lazy handle on one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            if name not in self._cache:
                self._cache[name] = read_table(self.spark, self.sf_dir, name)
            return self._cache[name]
        raise AttributeError(name)
