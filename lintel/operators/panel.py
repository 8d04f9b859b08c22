"""Panels: densify, lags and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators.joins import small_rows

# Values of a grid's axis that are broadcast; a longer axis is left to the planner.
BROADCAST_VALUES = 100_000


def densify(df: DataFrame, keys: Sequence[str], time_col: str,
            measures: Sequence[str], fill: float = 0.0,
            full_range: bool = False) -> DataFrame:
    """J8 + P24: every distinct key combination × every period, measures
    filled with ``fill`` where the pair was absent.

    By default the periods are the ones present anywhere in ``df`` (a period
    absent for every key stays absent, D9); ``full_range`` uses every period
    from min to max instead.  The grid is the product of two distinct frames,
    of any size: its rows are the result's rows.
    """
    keys = list(keys)
    if full_range:
        periods = (df.agg(F.min(time_col).alias("_lo"), F.max(time_col).alias("_hi"))
                   .where("_lo IS NOT NULL").select(F.explode(F.sequence("_lo", "_hi")).alias(time_col)))
    else:
        periods = _values(df, time_col)
    return _on_grid(_times(df.select(*keys).distinct(), periods), df, [*keys, time_col], measures, fill)


def expand_grid(df: DataFrame, keys: Sequence[str], time_col: str,
                measures: Sequence[str], fill: float = 0.0) -> DataFrame:
    """J8 + P24, full product: every value of each key × every period (like
    ``expand.grid`` of the distinct values), measures filled where absent."""
    keys = list(keys)
    grid = df.select(keys[0]).distinct()
    for c in [*keys[1:], time_col]:
        grid = _times(grid, _values(df, c))
    return _on_grid(grid, df, [*keys, time_col], measures, fill)


def _values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).where(F.col(c).isNotNull()).distinct()


def _times(grid: DataFrame, axis: DataFrame) -> DataFrame:
    """Every row of ``grid`` with every value of ``axis``, where the grid's rows are."""
    return grid.crossJoin(small_rows(axis, BROADCAST_VALUES))


def _on_grid(grid: DataFrame, df: DataFrame, on: list[str], measures: Sequence[str], fill: float) -> DataFrame:
    return grid.join(df, on=on, how="left").fillna(fill, subset=list(measures))


def with_lags(df: DataFrame, keys: Sequence[str], time_col: str,
              cols: Sequence[str], suffix: str = "_t1") -> DataFrame:
    """Previous row's value per series ordered by time (NULL first)."""
    w = Window.partitionBy(*keys).orderBy(time_col)
    for c in cols:
        df = df.withColumn(c + suffix, F.lag(c).over(w))
    return df


def with_difference(df: DataFrame, col: str, lag_col: str, name: str) -> DataFrame:
    """First difference ``x - lag(x)``."""
    return df.withColumn(name, F.col(col) - F.col(lag_col))
