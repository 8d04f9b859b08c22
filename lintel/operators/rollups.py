"""Aggregations, ordering, top-k and set operations (A-, O-, G-series).

Every grouped aggregate is a hash aggregate with a map-side partial step, so
a hot key is combined inside each task before the shuffle and never lands on
one task as raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_sum(c: str | Column) -> Column:
    """Null-skipping sum that is 0 (not NULL) for an all-NULL group."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0.0))


def sum_by(df: DataFrame, keys: Sequence[str], measures: dict[str, str | Column]) -> DataFrame:
    """A1/A2/A3/A4: ``out_name -> measure`` summed per key set (0 for an
    all-NULL group)."""
    return df.groupBy(*keys).agg(*[zero_sum(m).alias(name) for name, m in measures.items()])


def pivot_sum(df: DataFrame, row_key: str, pivot_col: str, values: Sequence[str],
              measure: str, prefix: str = "p_") -> DataFrame:
    """``row_key`` × fixed ``values`` of ``pivot_col``; empty cells NULL.

    The value list is given, so Spark needs no extra job to discover it."""
    out = df.groupBy(row_key).pivot(pivot_col, list(values)).agg(F.sum(measure))
    for v in values:
        out = out.withColumnRenamed(v, f"{prefix}{v.lower()}")
    return out


def frequency(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Row count per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias(name))


def exact_quantiles(df: DataFrame, c: str, probs: Sequence[float],
                    name_fmt: str = "q{:03d}") -> DataFrame:
    """A10: exact quantiles with linear interpolation (one row)."""
    arr = F.percentile(F.col(c), F.array(*[F.lit(float(p)) for p in probs]))
    out = df.agg(arr.alias("_q"))
    return out.select(*[F.col("_q")[i].alias(name_fmt.format(int(round(p * 100))))
                        for i, p in enumerate(probs)])


def rmse(a: str | Column, b: str | Column) -> Column:
    """``sqrt(mean((a-b)^2))`` over rows where both are non-NULL."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    d = a - b
    return F.sqrt(F.avg(d * d))


def order_desc(df: DataFrame, measure: str, tie_keys: Sequence[str]) -> DataFrame:
    """O1: measure descending (NULLs last), ties broken by key."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *[F.col(k).asc() for k in tie_keys])


def top_k(df: DataFrame, measure: str, tie_keys: Sequence[str], k: int) -> DataFrame:
    """O2: top ``k`` rows; planned as a bounded heap per task
    (TakeOrderedAndProject), never a full sort on one task."""
    return order_desc(df, measure, tie_keys).limit(k)


def union_fill(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by column name; columns missing on one side are NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def one_sided(a: DataFrame, b: DataFrame, key: str,
              labels: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """Distinct key values present on one side only, with the side."""
    ka = a.select(key).filter(F.col(key).isNotNull()).distinct()
    kb = b.select(key).filter(F.col(key).isNotNull()).distinct()
    return (ka.join(kb, key, "left_anti").withColumn("side", F.lit(labels[0]))
            .unionByName(kb.join(ka, key, "left_anti").withColumn("side", F.lit(labels[1]))))
