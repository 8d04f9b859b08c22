"""Vectors: similarity ranking (T7) and a materialised vector cache."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lintel.operators.joins import attach_scalars
from lintel.operators.text import text_key


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two numeric arrays, accumulated in double, JVM-side."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def rank_by_similarity(df: DataFrame, vec: str, query: DataFrame, query_col: str,
                       k: int | None = None, tie_key: str | None = None) -> DataFrame:
    """``score = vec · query`` for every row; optionally the top ``k``.

    ``query`` is a one-row frame (the query vector), attached to every row
    by broadcast; the top-k is a bounded per-task heap, not a full sort."""
    scored = attach_scalars(df, query.select(query_col)).withColumn("score", dot(vec, query_col)).drop(query_col)
    if k is None:
        return scored
    order = [F.col("score").desc()] + ([F.col(tie_key)] if tie_key else [])
    return scored.orderBy(*order).limit(k)


# ------------------------------------------------------------ vector cache

Encoder = Callable[[pd.Series], pd.DataFrame]

SHAPE_SCHEMA = "n_chars double, n_words double, n_lines double"


def shape_encoder(texts: pd.Series) -> pd.DataFrame:
    """Deterministic stand-in encoder: a 3-d shape vector of a text."""
    return pd.DataFrame({
        "n_chars": texts.str.len().astype("float64"),
        "n_words": texts.str.count(" ").astype("float64") + 1.0,
        "n_lines": texts.str.count("\n").astype("float64") + 1.0,
    })


def cache_vectors(df: DataFrame, text: str, path: str, encoder: Encoder, schema: str) -> DataFrame:
    """Encode only texts whose hash is not yet in the parquet cache at
    ``path``, append them, and return the whole cache.

    New texts = distinct keys left-anti-joined against the cache keys (both
    sides shuffled by key when large); the encoder runs in ``mapInPandas``.
    Each append carries a ``batch`` number one above the cache's last."""
    spark = df.sparkSession
    keyed = (df.select(text_key(text).alias("text_key"), F.col(text).alias("_t"))
             .filter(F.col("_t").isNotNull()).dropDuplicates(["text_key"]))
    try:
        cache = spark.read.parquet(path)
        last = cache.agg(F.max("batch").alias("_last"))
        new = keyed.join(cache.select("text_key"), "text_key", "left_anti")
        new = attach_scalars(new, last).withColumn("batch", F.col("_last") + 1).drop("_last")
    except AnalysisException:
        new = keyed.withColumn("batch", F.lit(0))

    out_schema = f"text_key string, {schema}, batch int"

    def run(batches):
        for b in batches:
            enc = encoder(b["_t"])
            enc.insert(0, "text_key", b["text_key"].values)
            enc["batch"] = b["batch"].astype("int32").values
            yield enc

    encoded = new.withColumn("batch", F.col("batch").cast("int")).mapInPandas(run, out_schema)
    encoded.write.mode("append").parquet(path)
    return spark.read.parquet(path)
