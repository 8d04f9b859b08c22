"""Exact quantiles of a column of any length by narrowing ranges.

``percentile`` gathers every distinct value in one task.  Here each rank that
the probabilities ask for keeps a range of values that holds it.  A pass takes
a mergeable sketch of every range (bounded in size) for two values close around the
rank, and a second one counts the rows below and between them, so ranges are
exact although sketches are not; ranges narrow until each holds at most
``limit`` distinct values, or one.  The last pass counts the rows of each value
in the ranges (combined before the shuffle) and picks the values at the ranks.
Only a few numbers a rank reach the driver.

Defined cases: NULLs are skipped; without values the quantiles are NULL; equal
values count each; NaN is larger than any number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 1000      # of the sketch: it is off by at most one in so many rows
LIMIT = 100_000
PASSES = 60


@dataclass
class Range:
    """The value of one rank lies in [low, high]; ``below`` rows are smaller, ``inside`` lie within."""

    rank: int
    low: float
    high: float
    below: int
    inside: int

    def holds(self, v):
        return v.between(F.lit(self.low), F.lit(self.high))

    @property
    def share(self) -> float:
        return (self.rank - self.below + 0.5) / self.inside

    def tighten(self, low: float, high: float, under: int, within: int) -> None:
        """Take the part that holds the rank: below ``low``, from ``low`` to ``high``, or above."""
        at = self.rank - self.below
        if at < under:
            self.high, self.inside = low, under + within       # an upper bound; counted anew next
        elif at < under + within:
            self.low, self.high = low, high
            self.below, self.inside = self.below + under, within
        else:
            self.low, self.inside = high, self.inside - under


def _narrow(df: DataFrame, ranges: list[Range]) -> None:
    v = F.col("v")
    step = 2 / ACCURACY
    asked = []
    for i, r in enumerate(ranges):
        shares = [max(0.0, r.share - step), min(1.0, r.share + step)]
        asked.append(F.percentile_approx(F.when(r.holds(v), v), F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias(f"q{i}"))
    near = df.agg(*asked).first()
    counts = []
    for i, r in enumerate(ranges):
        low, high = near[i]
        mine = r.holds(v)
        counts += [F.count(F.when(mine & (v < low), 1)).alias(f"u{i}"),
                   F.count(F.when(mine & v.between(low, high), 1)).alias(f"w{i}"),
                   F.count(F.when(v < r.low, 1)).alias(f"b{i}")]
    seen = df.agg(*counts).first()
    for i, r in enumerate(ranges):
        r.below = seen[f"b{i}"]
        r.tighten(near[i][0], near[i][1], seen[f"u{i}"], seen[f"w{i}"])


def values_at(df: DataFrame, column: str, ranks: Sequence[int], n: int, least, most, limit: int = LIMIT) -> DataFrame:
    """(rank, value) of the ranks (from 0) among ``n`` non-null values."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    ranges = [Range(r, least, most, 0, n) for r in ranks]
    for _ in range(PASSES):
        wide = [r for r in ranges if r.inside > limit and r.low < r.high]
        if not wide:
            break
        _narrow(v, wide)
    seen = v.agg(*[F.count(F.when(F.col("v") < r.low, 1)).alias(f"b{i}") for i, r in enumerate(ranges)]).first()
    for i, r in enumerate(ranges):
        r.below = seen[f"b{i}"]
    spark = df.sparkSession
    told = F.broadcast(spark.createDataFrame([(r.rank, r.low, r.high, r.below) for r in ranges],
                                             "rank long, low double, high double, below long"))
    every = None
    for r in ranges:
        every = r.holds(F.col("v")) if every is None else every | r.holds(F.col("v"))
    each = v.where(every).groupBy("v").count()
    own = each.join(told, F.col("v").between(F.col("low"), F.col("high")))
    upto = F.col("below") + F.sum("count").over(Window.partitionBy("rank").orderBy("v"))
    # a window of one rank holds at most `limit` distinct values
    return (own.withColumn("upto", upto).where(F.col("upto") > F.col("rank"))
            .groupBy("rank").agg(F.min("v").alias("value")))


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], limit: int = LIMIT) -> DataFrame:
    """(p, value): quantiles with linear interpolation between neighbours."""
    spark = df.sparkSession
    n, least, most = df.agg(F.count(column), F.min(F.col(column).cast("double")),
                            F.max(F.col(column).cast("double"))).first()
    if not n:
        return spark.createDataFrame([(float(p), None) for p in probabilities], "p double, value double")
    at = [(float(p), p * (n - 1)) for p in probabilities]
    ranks = sorted({k for _, x in at for k in (math.floor(x), math.ceil(x))})
    value = values_at(df, column, ranks, n, least, most, limit)
    asked = spark.createDataFrame([(p, math.floor(x), math.ceil(x), x - math.floor(x)) for p, x in at],
                                  "p double, a long, b long, part double")
    low = value.select(F.col("rank").alias("a"), F.col("value").alias("va"))
    high = value.select(F.col("rank").alias("b"), F.col("value").alias("vb"))
    return (asked.join(low, "a").join(high, "b")
            .select("p", (F.col("va") + F.col("part") * (F.col("vb") - F.col("va"))).alias("value")))
