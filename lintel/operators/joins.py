"""Joins (J-series).

Broadcast is never assumed: ``small`` hints a side only when the optimizer's
size estimate for it is under a bound, otherwise the side is left to the
planner (sort-merge / shuffled hash), and AQE may still switch to broadcast
at runtime once it has measured the real size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.session import written

# Hint a side as broadcast only below this estimated size.
DEFAULT_BROADCAST_BYTES = 32 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for ``df`` (no job is run)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # noqa: BLE001 - Spark Connect or an unexpected plan
        return None


def small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its estimated size is below ``max_bytes``."""
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def small_rows(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave it to
    the planner.

    For derived dimensions (a distinct over a large table, a filtered slice)
    Catalyst's estimate is the size of the source, so :func:`small` would
    refuse; this counts at most ``max_rows + 1`` rows instead (a bounded
    job), which proves the bound exactly."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def lookup_left(df: DataFrame, dim: DataFrame, on: str | Sequence[str],
                max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Left lookup join against a dimension (broadcast when small)."""
    return df.join(small(dim, max_bytes), on=on, how="left")


def lookup_inner(df: DataFrame, dim: DataFrame, on: str | Sequence[str],
                 max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Inner lookup join; rows without a match are dropped."""
    return df.join(small(dim, max_bytes), on=on, how="inner")


def dedupe_lookup(dim: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keep one row per lookup key so a left join cannot fan out.

    The surviving row is the smallest by all other columns (deterministic)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in dim.columns if c not in keys]
    if not rest:
        return dim.dropDuplicates(keys)
    picked = F.min(F.struct(*rest)).alias("_v")
    return dim.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def split_values(fact: DataFrame, mapping: DataFrame, key: str,
                 value_cols: Sequence[str], max_rows: int = 1_000_000) -> DataFrame:
    """J4 + W3: many-to-many left join that splits each value evenly.

    A key mapped to k targets yields k rows with value × 1/k; an unmapped key
    keeps one row with value × 1.  The multiplier is computed on the small
    mapping (``1/count(*) OVER (PARTITION BY key)``), so the fact side needs
    no row index and no extra shuffle; totals are conserved.

    The mapping is broadcast when it has at most ``max_rows`` rows (checked),
    so the fact side is never shuffled by its few, possibly skewed, keys.
    """
    weighted = mapping.withColumn(
        "_weight", F.lit(1.0) / F.count(F.lit(1)).over(_w(key)))
    out = fact.join(small_rows(weighted, max_rows), on=key, how="left")
    w = F.coalesce(F.col("_weight"), F.lit(1.0))
    for c in value_cols:
        out = out.withColumn(c, F.col(c) * w)
    return out.drop("_weight")


def _w(key: str):
    from pyspark.sql import Window
    return Window.partitionBy(key)


def join_split_hot(big: DataFrame, other: DataFrame, key: str, how: str = "left",
                   hot_rows: int = 1_000_000, max_hot_keys: int = 100_000) -> DataFrame:
    """Equi-join that splits hot keys off before shuffling.

    Keys carrying more than ``hot_rows`` rows of ``big`` (found with one
    partially pre-aggregated count) are joined against a broadcast of their
    few matching rows of ``other``; only the remaining keys go through the
    shuffled join.  A key holding a third of all rows therefore never lands
    on one reducer.  The hot-key list is at most ``len(big) / hot_rows``
    long and its size is checked before it is broadcast; ``other`` must hold
    few rows per key (a lookup such as scores by text key).  Without a hot key
    ``big`` is read only for the count and the join."""
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = written(counts.filter(F.col("_n") > hot_rows).select(key), "hot")
    if hot.isEmpty():
        return big.join(other, key, how)
    hot_b = small_rows(hot, max_hot_keys)
    big_hot = big.join(hot_b, key, "left_semi")
    big_cold = big.join(hot_b, key, "left_anti")
    other_hot = small_rows(other.join(hot_b, key, "left_semi"), max_hot_keys)
    return big_hot.join(other_hot, key, how).unionByName(big_cold.join(other, key, how))


def full_reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on all shared keys, NULL keys matching NULL keys.

    Both inputs are expected to be pre-aggregated on ``keys`` (one row per
    key), as the aggregation is not pushed through a full join by Catalyst.
    """
    l = left.select(*[F.col(k).alias(f"_l_{k}") for k in keys],
                    *[c for c in left.columns if c not in keys])
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond: Column | None = None
    for k in keys:
        e = F.col(f"_l_{k}").eqNullSafe(F.col(f"_r_{k}"))
        cond = e if cond is None else cond & e
    j = l.join(r, on=cond, how="full")
    key_cols = [F.coalesce(F.col(f"_l_{k}"), F.col(f"_r_{k}")).alias(k) for k in keys]
    rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return j.select(*key_cols, *rest)


def full_with_suffixes(left: DataFrame, right: DataFrame, key: str,
                       suffixes: tuple[str, str], fill: float | None = 0.0) -> DataFrame:
    """Full outer join on one key, measures renamed ``<col><suffix>``."""
    ls, rs = suffixes
    l = left.select(F.col(key).alias("_lk"), *[F.col(c).alias(c + ls) for c in left.columns if c != key])
    r = right.select(F.col(key).alias("_rk"), *[F.col(c).alias(c + rs) for c in right.columns if c != key])
    j = l.join(r, F.col("_lk") == F.col("_rk"), "full")
    j = j.select(F.coalesce("_lk", "_rk").alias(key), *[c for c in j.columns if c not in ("_lk", "_rk")])
    if fill is not None:
        j = j.fillna(fill, subset=[c for c in j.columns if c != key])
    return j


def recode_via_lookups(df: DataFrame, code_col: str, out_col: str,
                       layers: Sequence[tuple[DataFrame, str, str]],
                       drop_unresolved: bool = True,
                       max_rows: int = 1_000_000) -> DataFrame:
    """Resolve a code through several lookup tables; the first layer with
    a match wins (e.g. region mapping, then overrides, then the ISO table).

    ``layers`` are ``(table, key_col, value_col)``; each is deduplicated on its
    key and joined left; rows left unresolved are dropped when asked (P4).
    Code lists are small but often of unknown size to the planner (local
    rows, derived tables), so each layer's row count is checked against
    ``max_rows`` before it is broadcast: the fact is never shuffled by its
    few, skewed codes.
    """
    out = df
    vals = []
    for i, (tab, k, v) in enumerate(layers):
        t = dedupe_lookup(tab.select(F.col(k).alias(f"_k{i}"), F.col(v).alias(f"_v{i}")), f"_k{i}")
        out = out.join(small_rows(t, max_rows), F.col(code_col) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        vals.append(F.col(f"_v{i}"))
    out = out.withColumn(out_col, F.coalesce(*vals)).drop(*[f"_v{i}" for i in range(len(layers))])
    if drop_unresolved:
        out = out.filter(F.col(out_col).isNotNull())
    return out


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row frame on every row.

    ``one_row`` is an aggregate without grouping keys (or one constant row),
    so it holds exactly one row: it is broadcast, and each row of ``df``
    meets that single row (the planner runs it as a nested-loop join whose
    build side is the one row; no pairs beyond one per row are formed).
    """
    right = one_row.withColumn("_scalar_key", F.lit(0))
    return (df.withColumn("_scalar_key", F.lit(0))
            .join(F.broadcast(right), "_scalar_key").drop("_scalar_key"))
