"""Embedding whitening by polarisation (operator 13).

Components become integers ``floor(factor * c)``.  The fit list is every
distinct integer vector once: ``n`` of them, with sums ``S``.  A second pass
aggregates the exact squares of the centred values ``n * x - S`` of every
dimension, and those of the sum of every pair of dimensions; by polarisation
``2 cov(i, j) = var(i + j) - var(i) - var(j)``, so differences of these
variances give all cross-covariances as integers over ``n ** 3``.  Only the
matrix reaches the driver, for ``eigh``; rows are whitened in a third pass.

Sums are exact whatever the size: squares are taken in limbs that cannot
overflow, a task adds them up as Python integers, and these travel as limbs of
``LIMB`` bits that Spark adds up before and after its shuffle.

Defined cases: a vector that is null or holds null or non-finite entries is
dropped; vectors of each length are a fit of their own, and empty ones have no
component; repeated rows are one of the fit list and each get their rows; a
null id stays null; a component without variance (``FLAT`` of the largest, or
less) has null ``whitened``, and ``identity_error`` is over the others (null if
there are none), ``explained`` null where nothing varies; an empty table gives
an empty result; other columns are not looked at.  ``deviation`` has 38 digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import integer_vectors, ranges, matrix, stored

COMPONENTS = 4
FLAT = 1e-11
LIMB, LIMBS = 40, 4
DIGIT = 24            # bits of a limb whose squares are summed over CHUNK rows in 64 bits
CHUNK = 4096
SCHEMA = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double,"
          " identity_error double")


def centred(x: np.ndarray, n: int, total: list[int], most: int) -> np.ndarray:
    """``n * x - S``, exact; ``most`` bounds the values."""
    kind = np.int64 if most < 1 << 61 else object
    return x.astype(kind) * n - np.array(total, kind)


def square_sums(z: np.ndarray, most: int) -> np.ndarray:
    """The exact sum of squares of each column, as Python integers; ``most`` bounds the values."""
    if z.dtype == object:
        return (z * z).sum(0) if len(z) else np.zeros(z.shape[1], object)
    bits = most.bit_length()
    if 2 * bits + len(z).bit_length() < 63:
        return np.einsum("rc,rc->c", z, z).astype(object)
    count = -(-bits // DIGIT)
    mask = (1 << DIGIT) - 1
    digits = [z >> (DIGIT * k) & mask if k < count - 1 else z >> (DIGIT * k) for k in range(count)]
    out = np.zeros(z.shape[1], object)
    for a in range(count):
        for b in range(a, count):
            part = np.einsum("rc,rc->c", digits[a], digits[b]).astype(object)
            out += part * ((1 if a == b else 2) << (DIGIT * (a + b)))
    return out


def _limbs(values) -> list[pa.Array]:
    """Columns of limbs: all but the last are not negative."""
    rows = [[v >> (LIMB * k) & ((1 << LIMB) - 1) if k < LIMBS - 1 else v >> (LIMB * k) for k in range(LIMBS)]
            for v in map(int, values)]
    return [pa.array([r[k] for r in rows], pa.int64()) for k in range(LIMBS)]


SUMS = "pos long, " + ", ".join(f"l{k} long" for k in range(LIMBS))
NAMES = ["pos"] + [f"l{k}" for k in range(LIMBS)]


def _added(parts: DataFrame) -> dict[int, int]:
    """The totals of limbs by ``pos``."""
    rows = parts.groupBy("pos").agg(*[F.sum(c).alias(c) for c in NAMES[1:]]).toArrow().to_pylist()
    return {r["pos"]: sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in rows}


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of each dimension."""
    def run(batches):
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = matrix(batch.column(0), dim)
            n += len(x)
            for a in range(0, len(x), CHUNK):    # halves, as whole values could overflow
                part = x[a:a + CHUNK].astype(np.int64)
                total += (part >> 32).sum(0).astype(object) * (1 << 32) + (part & 0xFFFFFFFF).sum(0).astype(object)
        yield pa.record_batch([pa.array(range(dim + 1), pa.int64()), *_limbs([*total, n])], NAMES)

    got = _added(fit.mapInArrow(run, SUMS))
    return got.get(dim, 0), [got.get(i, 0) for i in range(dim)]


def scatter(fit: DataFrame, n: int, total: list[int], most: int) -> list[list[int]]:
    """``n ** 3`` times the covariance matrix, exact, by polarisation."""
    dim = len(total)
    first = np.cumsum([0, *range(dim, 0, -1)]).tolist()     # of dimension i: itself, then its sums with later ones

    def run(batches):
        out = np.zeros(first[-1], object)
        for batch in batches:
            x = matrix(batch.column(0), dim)
            for a in range(0, len(x), CHUNK):
                d = centred(x[a:a + CHUNK], n, total, most)
                for i in range(dim):
                    out[first[i]] += square_sums(d[:, i:i + 1], most)[0]
                    if i + 1 < dim:
                        out[first[i] + 1:first[i + 1]] += square_sums(d[:, i:i + 1] + d[:, i + 1:], 2 * most)
        yield pa.record_batch([pa.array(range(len(out)), pa.int64()), *_limbs(out)], NAMES)

    got = _added(fit.mapInArrow(run, SUMS))
    own = [got[first[i]] for i in range(dim)]
    out = [[0] * dim for _ in range(dim)]
    for i in range(dim):
        out[i][i] = own[i]
        for j in range(i + 1, dim):
            out[i][j] = out[j][i] = (got[first[i] + j - i] - own[i] - own[j]) // 2
    return out


class Whitener:
    """Centre and leading components of one fit."""

    def __init__(self, n: int, total: list[int], most: int, scattered: list[list[int]]):
        self.n, self.total, self.most = n, total, most
        cov = np.array([[v / n ** 3 for v in row] for row in scattered], np.float64).reshape(len(total), len(total))
        value, vector = np.linalg.eigh(cov)
        count = min(COMPONENTS, len(total))
        value, vector = value[::-1][:count], vector[:, ::-1][:, :count]
        trace = sum(scattered[i][i] for i in range(len(total)))
        self.explained = [float(v) / (trace / n ** 3) if trace else None for v in value]
        self.live = (value > FLAT * value[:1]) & (value > 0)
        self.axes = vector / np.sqrt(np.where(self.live, value, 1))

    def values(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's components (flat ones not a number), and its exact squared deviation."""
        d = centred(x, self.n, self.total, self.most)
        w = (d.astype(np.float64) / self.n) @ self.axes
        w[:, ~self.live] = np.nan
        if d.dtype != object and 2 * self.most.bit_length() + len(self.total).bit_length() < 63:
            return w, np.einsum("rc,rc->r", d, d)
        return w, square_sums(np.ascontiguousarray(d.T), self.most)


def identity_error(fit: DataFrame, white: Whitener, dim: int) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    live = np.flatnonzero(white.live).tolist()
    if not live:
        return None

    def run(batches):
        for batch in batches:
            w, _ = white.values(matrix(batch.column(0), dim))
            yield pa.record_batch([pa.array(w[:, k]) for k in live], [f"w{k}" for k in live])

    seen = fit.mapInArrow(run, ", ".join(f"w{k} double" for k in live))
    pairs = [(a, b) for a in live for b in live if a <= b]
    row = seen.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(row, pairs))


def whiten(vectors: DataFrame, factor: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector."""
    spark = vectors.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    every = integer_vectors(vectors, factor, id_col, vec_col)
    for dim, kind, most in ranges(every):
        if not dim:
            continue
        own = every.where(F.size("x") == dim).select("id", F.col("x").cast(f"array<{kind}>").alias("x"))
        fit = stored(own.select("x").distinct(), "fit-list")
        n, total = sums(fit, dim)
        bound = n * most + max(map(abs, total))
        white = Whitener(n, total, bound, scatter(fit, n, total, bound))
        out = out.unionByName(_apply(own, white, dim, identity_error(fit, white, dim)))
    return out


def _apply(own: DataFrame, white: Whitener, dim: int, error: float | None) -> DataFrame:
    count = len(white.explained)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), dim)
            w, dev = white.values(x)
            at = np.repeat(np.arange(len(x)), count)
            digits = (pa.array(dev, pa.int64()).cast(pa.decimal128(38, 0)) if dev.dtype != object
                      else pa.array([decimal(v) for v in dev], pa.decimal128(38, 0)))
            yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, count + 1), len(x)),
                                                                                pa.int32()),
                                   pa.array(np.full(len(at), white.n), pa.int64()), digits.take(pa.array(at)),
                                   pa.array(w.ravel(), pa.float64(), from_pandas=True),
                                   pa.array(white.explained * len(x), pa.float64()),
                                   pa.array([error] * len(at), pa.float64())],
                                  ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(run, SCHEMA)


def decimal(v: int):
    from decimal import Decimal
    return Decimal(int(v))
