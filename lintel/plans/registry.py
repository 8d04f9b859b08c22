"""Registered queries: name → (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables of that folder.  Oracle strings run on DuckDB against the same
parquet tables (pre-registered as views) and must produce the same column
names; money is rounded to 4 decimals and model outputs to 6 on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def register(name: str, operators: tuple[str, ...], oracle: str | None):
    """Decorator: add a query builder (and its oracle SQL, if expressible)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPERATORS[name] = operators
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco
