"""The k rows most similar to each of many query vectors (T7), exact.

Every task scores its rows against one block of queries by matrix products and
keeps, a query, only the rows that may be among its k best: those not below the
k-th best score so far by more than the product's rounding error.  They are
scored once more by sums in the order of the components, so that equal vectors
have equal scores wherever they lie, and only k of them a query stay.  A window
limited to k a query before and after its shuffle merges the tasks; no table of
rows times queries is written.

Queries are a stated set.  A block of them goes to every task, at most
``BLOCK_BYTES`` large; more blocks mean more passes over the rows.

Defined cases: rows whose id or vector is NULL, whose vector has NULL or
non-finite components or another length than the query are no neighbours of it;
queries like that have no neighbours; equal scores go to the smaller id; ids
that repeat stay apart rows; without rows or queries the result is empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
ROWS = 1024         # rows of one matrix product
PAIRS = 1 << 15     # pairs scored exactly at a time


def _usable(vec: str, dims: int):
    v = F.col(vec)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    return v.isNotNull() & (F.size(v) == dims) & F.coalesce(ok, F.lit(False))


def _in_order(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise dot products, components added one after another."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[:, j]
    return out


class Best:
    """The k best (score, id) of each query among the rows seen."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.norm = np.sqrt((queries * queries).sum(1))
        self.at, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(queries), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        rough = x @ self.q.T
        slack = 4e-16 * (x.shape[1] + 2) * np.sqrt((x * x).sum(1).max()) * self.norm
        floor = self.floor
        if len(x) > self.k:
            floor = np.maximum(floor, np.partition(rough, len(x) - self.k, axis=0)[len(x) - self.k] - slack)
        row, at = np.nonzero(rough >= floor - slack)
        for s in range(0, len(row), PAIRS):
            r, a = row[s:s + PAIRS], at[s:s + PAIRS]
            self._merge(a, ids[r], _in_order(x[r], self.q[a]))

    def _merge(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        at, ids, score = (np.concatenate(p) for p in ((self.at, at), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        place = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(at) else at
        keep = place < self.k
        self.at, self.id, self.score = at[keep], ids[keep], score[keep]
        full = place == self.k - 1
        self.floor[at[full]] = score[full]


def _block(df: DataFrame, vec: str, key: str, queries: pd.DataFrame, dims: int, k: int) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(
        (queries["query"].to_numpy(np.int64), np.stack(queries["vec"].to_list()).astype(float)))

    def run(batches):
        names, q = sent.value
        best = Best(q, k)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), dims)
            for s in range(0, len(ids), ROWS):
                best.add(ids[s:s + ROWS], x[s:s + ROWS])
        yield pa.record_batch([pa.array(names[best.at]), pa.array(best.id), pa.array(best.score)],
                              ["query", "id", "score"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v")).where(F.col("id").isNotNull())
    return rows.where(_usable("v", dims)).mapInArrow(run, "query long, id long, score double")


def top_k_many(df: DataFrame, vec: str, key: str, queries: DataFrame, k: int,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query, rank, id, score): the ``k`` rows of ``df`` with the largest dot product for each query.

    ``key`` and the queries' ``query`` are numbers; ``queries`` is (query,
    vec), a row per number.  The result has at most k rows a query."""
    spark = df.sparkSession
    q = queries.select(F.col("query").cast("long").alias("query"), F.col("vec").alias("vec")).where("query is not null")
    out = spark.createDataFrame([], "query long, id long, score double")
    for dims, n in q.groupBy(F.size("vec").alias("d")).count().where("d > 0").collect():     # a row per vector length
        mine = q.where(_usable("vec", dims))
        blocks = max(1, math.ceil(n * dims * 8 / block_bytes))
        for b in range(blocks):
            one = mine.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toPandas()
            if len(one):
                out = out.unionByName(_block(df, vec, key, one, dims, k))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def group_means(df: DataFrame, vec: str, group: str) -> DataFrame:
    """(query, vec): the mean vector of every group, rounded to six digits, so that it does not depend on the order of sums."""
    each = df.where(F.col(group).isNotNull()).select(F.col(group).alias("query"), F.posexplode(vec).alias("at", "x"))
    mean = each.groupBy("query", "at").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    return mean.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("ms")).select(
        "query", F.transform("ms", lambda s: s["m"]).alias("vec"))
