"""Access to the parquet tables of one scale-factor folder.

Parquet carries its own schema, so nothing is inferred; Catalyst prunes the
columns and pushes filters into each scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


# Tables whose rows are long texts: per-row work on them is CPU-heavy, so a
# scan with fewer partitions than the cluster has cores is spread out first.
TEXT_TABLES = frozenset({"documents", "pages", "benchmark", "conversations"})


# Spread a text scan over at most this many partitions.
MAX_SPREAD = 256


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` when its scan yields fewer partitions than
    ``min(parallelism, MAX_SPREAD)``.

    A large input already has one partition per file split (far more than
    ``MAX_SPREAD``), so this never shuffles a big table; it matters when a
    few big row groups would otherwise put all the text work on a few tasks."""
    spark = df.sparkSession
    want = min_partitions or min(spark.sparkContext.defaultParallelism, MAX_SPREAD)
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


class Tables:
    """Lazy, per-session handle on ``<sf_dir>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            df = self.spark.read.parquet(self.path(name))
            self._cache[name] = spread(df) if name in TEXT_TABLES else df
        return self._cache[name]
