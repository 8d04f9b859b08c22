"""Attributes with validity, derived from a fact.

A fact that repeats an attribute of a key on its rows (a recipient's income
group) gives the attribute's history: one value a key and period, runs of equal
values merged to intervals.  Looking values up as of a period keeps every row
once, whatever the number of values a key has had.

Defined cases: within a period the value of the most rows holds, ties go to the
smallest; rows with a NULL key, period or value tell nothing; an interval lasts
until the next one starts, the last for good; periods before the first interval
and keys without any take ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators.joins import small


def history(fact: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """(key, value, valid_from, valid_to): ``valid_to`` is the next start, NULL in the last interval."""
    told = fact.where(F.col(key).isNotNull() & F.col(period).isNotNull() & F.col(value).isNotNull())
    each = told.groupBy(key, period, value).agg(F.count(F.lit(1)).alias("_n"))
    one = each.groupBy(key, period).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))["v"].alias(value))
    by = Window.partitionBy(key).orderBy(period)
    starts = one.withColumn("_before", F.lag(value).over(by)).where(~F.col("_before").eqNullSafe(F.col(value)))
    return starts.select(key, value, F.col(period).alias("valid_from"), F.lead(period).over(by).alias("valid_to"))


def as_of(df: DataFrame, intervals: DataFrame, key: str, period: str, value: str,
          unknown: str | Column = "Unknown") -> DataFrame:
    """``df`` with ``value`` as of each row's period; every row stays once."""
    found = small(intervals.select(F.col(key).alias("_key"), F.col(value).alias("_value"), "valid_from", "valid_to"))
    holds = ((df[key] == F.col("_key")) & (F.col("valid_from") <= df[period])
             & (F.col("valid_to").isNull() | (df[period] < F.col("valid_to"))))
    other = F.lit(unknown) if isinstance(unknown, str) else unknown
    return df.join(found, holds, "left").select(*[df[c] for c in df.columns], F.coalesce("_value", other).alias(value))
