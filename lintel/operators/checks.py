"""Data-quality checks returned as DataFrames (Q-series).

A check never collects rows to the driver: it is a small aggregate (or an
anti join) that the caller can assert on, write or show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators.joins import attach_scalars


def missing_keys(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Q1: distinct non-NULL keys of ``df`` that have no row in ``dim``."""
    return (df.select(key).filter(F.col(key).isNotNull()).distinct()
            .join(dim.select(key), key, "left_anti"))


def totals_conserved(before: DataFrame, after: DataFrame, value: str,
                     rel_tol: float = 1e-7, scale: float = 1.0, digits: int = 4) -> DataFrame:
    """Q2: one row ``(pre_total, post_total, conserved)``: the sums of
    ``value`` before and after a split agree to ``rel_tol``."""
    pre = before.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_pre"))
    post = after.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_post"))
    j = attach_scalars(pre, post)
    return j.select(F.round(F.col("_pre") * scale, digits).alias("pre_total"),
                    F.round(F.col("_post") * scale, digits).alias("post_total"),
                    (F.abs(F.col("_pre") - F.col("_post")) <= F.lit(rel_tol) * F.abs("_pre")).alias("conserved"))


def counts_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Q5: row counts before and after a dedupe (one row)."""
    a = before.agg(F.count(F.lit(1)).cast("bigint").alias("rows_before"))
    b = after.agg(F.count(F.lit(1)).cast("bigint").alias("rows_after"))
    return attach_scalars(a, b)
