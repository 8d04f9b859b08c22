"""Vector codes by adaptive-bound k-means (operator 12, Drake and Hamerly).

Components become integers ``floor(factor * c)``, vectors are cut into
``PARTS`` consecutive parts, and each part position has a codebook that starts
as that part of the ``ENTRIES`` vectors of smallest ids.  A round assigns every
part to its nearest entry and moves each entry to the floored mean of its parts.

What a round knows of a part is stored for the next one: its entry with an
upper bound of the distance, the next closest entries with lower bounds in
rising order, and one outer bound for all other entries.  When entries have
moved, each bound gives way by its entry's movement (the outer one by the
largest).  A part whose upper bound stays below all lower bounds keeps its
entry unseen; else the distance to its entry is measured, then those to the
listed entries whose bound is not above it, and only if the outer bound is not
above it either, all of them.  Measured distances are exact integers, so ties
go to the lower index and no rounding decides; bounds have a margin (``MARGIN``).
How many entries are listed adapts: twice as many (up to an eighth) when over an eighth of the
parts went past the outer bound, else as many as nearly all parts needed.

The rounds' states are tables under the shared folder; the one before is
deleted when the next is written.  Only codebooks and their sums (``ENTRIES``
vectors) reach the driver.

Defined cases: a vector that is null or holds null or non-finite components is
dropped; where the length is no multiple of ``PARTS`` the first parts are one
longer, and empty vectors have empty parts at distance 0; vectors of each
length have codebooks of their own; with fewer vectors than ``ENTRIES``, there
are as many entries; null ids come last among the smallest, and equal ids are
ordered by vector; repeated rows all count; a null label is a label of its
own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import discard, integer_vectors, matrix, ranges, read_back, small, write_out

ENTRIES, PARTS, ROUNDS = 256, 4, 4
LISTED = 16           # entries listed at first
MARGIN = 1e-6
BEYOND = 0xFFFF       # "all entries were measured"
ROWS = 2048


def down(v):
    return v - np.abs(v) * MARGIN - MARGIN


def up(v):
    return v + np.abs(v) * MARGIN + MARGIN


class Book:
    """One part position's entries, how far each has moved, and how many to list."""

    def __init__(self, entries: np.ndarray, most: int, moved: np.ndarray | None = None, listed: int = LISTED):
        width = max(1, entries.shape[1])
        reach = 4 * most * most * width
        # matrix products of this kind are exact
        self.kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object
        self.entries, self.most, self.moved = entries, most, moved
        self.listed = max(1, min(listed, len(entries) - 1))
        self.c = entries.astype(self.kind)
        self.cc = (self.c * self.c).sum(1)

    def all(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all entries."""
        return (x * x).sum(1)[:, None] - 2 * (x @ self.c.T) + self.cc[None]

    def some(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances to the entries ``which`` of each row."""
        d = x[:, None, :] - self.c[which]
        return (d * d).sum(2)


def _root(v: np.ndarray) -> np.ndarray:
    return np.sqrt(v.astype(np.float64))


def _order(d: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of each row by distance, then entry."""
    return np.lexsort((which, d), axis=1)


class Bounds:
    """What is known of one part of some rows.

    ``best`` and ``upper``: the entry and a bound of its distance; ``listed``
    (-1: none) and ``lower``: further entries; ``outer``: bound of all others.
    """

    def __init__(self, n: int, width: int):
        self.best = np.zeros(n, np.int64)
        self.upper = np.full(n, np.inf)
        self.listed = np.full((n, width), -1, np.int64)
        self.lower = np.full((n, width), -np.inf)
        self.outer = np.full(n, -np.inf)

    @classmethod
    def read(cls, best: pa.Array, listed: pa.Array, bounds: pa.Array) -> Bounds:
        sizes = np.diff(listed.offsets.to_numpy()) if len(listed) else np.zeros(0, np.int64)
        out = cls(len(sizes), int(sizes.max()) if len(sizes) else 0)
        out.best = best.to_numpy().astype(np.int64)
        names, values = listed.flatten().to_numpy(), bounds.flatten().to_numpy().astype(np.float64)
        to, at = np.cumsum(sizes), np.cumsum(sizes + 2)
        for m in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == m)
            v = values[(at[rows] - m - 2)[:, None] + np.arange(m + 2)]
            out.upper[rows], out.outer[rows] = v[:, 0], v[:, -1]
            if m:
                out.listed[rows, :m] = names[(to[rows] - m)[:, None] + np.arange(m)]
            out.lower[rows] = v[:, -1:]
            out.lower[rows, :m] = v[:, 1:-1]
        return out

    def columns(self) -> list[pa.Array]:
        """best, listed, and upper, lower ..., outer in a row."""
        have = self.listed >= 0
        sizes = have.sum(1)
        values = np.concatenate([self.upper[:, None], self.lower, self.outer[:, None]], 1).astype(np.float32)
        there = np.concatenate([np.ones((len(have), 1), bool), have, np.ones((len(have), 1), bool)], 1)
        return [pa.array(self.best.astype(np.int16)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                         pa.array(self.listed[have].astype(np.int16))),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes + 2)]), pa.int32()),
                                         pa.array(values[there]))]

    def give_way(self, book: Book) -> None:
        """Loosen the bounds by the entries' movements, and keep them in order."""
        self.upper = up(self.upper + book.moved[self.best])
        self.outer = down(self.outer - book.moved.max(initial=0.0))
        step = np.where(self.listed >= 0, book.moved[self.listed], 0.0)
        self.lower = np.where(self.listed >= 0, down(self.lower - step), self.outer[:, None])
        chain = np.concatenate([self.lower, self.outer[:, None]], 1)
        self.lower = np.minimum.accumulate(chain[:, ::-1], 1)[:, ::-1][:, :-1]

    def shorten(self, width: int) -> None:
        """List at most ``width`` entries; the bound of the first one left out becomes the outer bound."""
        if self.listed.shape[1] > width:
            self.outer = np.minimum(self.outer, self.lower[:, width])
            self.listed, self.lower = self.listed[:, :width], self.lower[:, :width]

    def widen(self, width: int) -> None:
        more = width - self.listed.shape[1]
        if more > 0:
            self.listed = np.pad(self.listed, ((0, 0), (0, more)), constant_values=-1)
            self.lower = np.concatenate([self.lower, np.repeat(self.outer[:, None], more, 1)], 1)


def assign(x: np.ndarray, book: Book, known: Bounds | None) -> tuple[Bounds, np.ndarray]:
    """Bounds after assigning all rows to their nearest entries, and how many listed entries each needed."""
    x = x.astype(book.kind)
    need = np.zeros(len(x), np.int64)
    if known is None:
        known, todo = Bounds(len(x), 0), np.arange(len(x))
    else:
        known.give_way(book)
        known.shorten(book.listed)
        todo = np.flatnonzero(~(known.upper < _least(known)))
        known.upper[todo] = up(_root(book.some(x[todo], known.best[todo, None])[:, 0]))
        todo = todo[~(known.upper[todo] < _least(known)[todo])]
        inner = todo[known.upper[todo] < known.outer[todo]]
        todo = todo[~(known.upper[todo] < known.outer[todo])]
        for a in range(0, len(inner), ROWS):
            _among(x, book, known, inner[a:a + ROWS], need)
    known.widen(book.listed)
    for a in range(0, len(todo), ROWS):
        _over_all(x, book, known, todo[a:a + ROWS])
    need[todo] = BEYOND
    return known, need


def _least(b: Bounds) -> np.ndarray:
    return np.minimum(b.lower[:, 0], b.outer) if b.lower.shape[1] else b.outer


def _among(x: np.ndarray, book: Book, b: Bounds, rows: np.ndarray, need: np.ndarray) -> None:
    """Measure only the listed entries whose bound is not above the upper one."""
    z = (b.lower[rows] <= b.upper[rows, None]).sum(1)        # a prefix, as bounds rise; listed, as outer is above
    need[rows] = z
    wide = int(z.max())
    which = np.concatenate([b.best[rows, None], b.listed[rows, :wide]], 1)
    out = np.arange(wide + 1)[None] > z[:, None]             # not to be measured
    d = book.some(x[rows], which)
    far = _root(d)
    # the integers decide; those not measured come last
    exact = np.where(out, d.max(initial=0) + 1, d)
    first = _order(exact, np.where(out, len(book.c), which))[:, 0]
    win = np.take_along_axis(which, first[:, None], 1)[:, 0]
    near = np.take_along_axis(far, first[:, None], 1)[:, 0]
    # the others measured, with their distances as bounds
    low = np.where(out[:, 1:], b.lower[rows, :wide], 0.0)
    low = np.concatenate([np.zeros((len(rows), 1)), low], 1)
    low = np.where(out, low, down(far))
    keep = np.ones(which.shape, bool)
    np.put_along_axis(keep, first[:, None], False, 1)
    listed, lower = which[keep].reshape(len(rows), wide), low[keep].reshape(len(rows), wide)
    listed = np.concatenate([listed, b.listed[rows, wide:]], 1)
    lower = np.concatenate([lower, b.lower[rows, wide:]], 1)
    order = np.argsort(np.where(listed < 0, np.inf, lower), 1, kind="stable")
    b.listed[rows] = np.take_along_axis(listed, order, 1)
    b.lower[rows] = np.take_along_axis(lower, order, 1)
    b.best[rows], b.upper[rows] = win, up(near)


def _over_all(x: np.ndarray, book: Book, b: Bounds, rows: np.ndarray) -> None:
    """Measure all entries and list the closest anew."""
    d = book.all(x[rows])
    order = np.argsort(d, 1, kind="stable")[:, :book.listed + 2]     # equal ones by entry
    far = _root(np.take_along_axis(d, order, 1))
    b.best[rows], b.upper[rows] = order[:, 0], up(far[:, 0])
    m = min(book.listed, order.shape[1] - 1)
    b.listed[rows] = -1
    b.listed[rows, :m] = order[:, 1:m + 1]
    b.outer[rows] = down(far[:, m + 1]) if order.shape[1] > m + 1 else np.inf
    b.lower[rows] = b.outer[rows, None]
    b.lower[rows, :m] = down(far[:, 1:m + 1])


# --------------------------------------------------------------- rounds

STATE = ", ".join(f"best{p} short, listed{p} array<short>, bounds{p} array<float>, need{p} int" for p in range(PARTS))
STATE_NAMES = [f"{c}{p}" for p in range(PARTS) for c in ("best", "listed", "bounds", "need")]


def _known(batch: pa.RecordBatch, p: int) -> Bounds:
    return Bounds.read(batch.column(f"best{p}"), batch.column(f"listed{p}"), batch.column(f"bounds{p}"))


def _round(state: DataFrame, books, dim: int, kind: str, label: str, fresh: bool) -> DataFrame:
    """The state after assigning all parts anew; ``state`` is the last one, or the vectors when ``fresh``."""
    cuts = np.array_split(np.arange(dim), PARTS)

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                x, cols = matrix(batch.column("x"), dim), []
                for p, book in enumerate(books.value):
                    b, need = assign(x[:, cuts[p]], book, None if fresh else _known(batch, p))
                    cols += [*b.columns(), pa.array(need, pa.int32())]
                yield pa.record_batch([batch.column("id"), batch.column("label"), batch.column("x"), *cols],
                                      ["id", "label", "x", *STATE_NAMES])

    return state.mapInArrow(run, f"id long, label {label}, x array<{kind}>, {STATE}")


def _moved(state: DataFrame, books: list[Book], dim: int) -> list[Book]:
    """The codebooks after one round: floored means, movements, and lengths of lists to come."""
    cuts = np.array_split(np.arange(dim), PARTS)
    k = len(books[0].entries)

    def run(batches):
        total, needs = np.zeros((PARTS, k, 1 + max(map(len, cuts))), object), np.zeros((PARTS, BEYOND + 1), np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), dim).astype(np.int64)
            for p in range(PARTS):
                to = batch.column(f"best{p}").to_numpy()
                part = x[:, cuts[p]]
                order = np.argsort(to, kind="stable")
                begin = np.flatnonzero(np.append(True, np.diff(to[order]) != 0))[:len(to)]
                n = np.diff(np.append(begin, len(to)))
                high = np.add.reduceat(part[order] >> 32, begin, 0).astype(object) * (1 << 32)
                value = high + np.add.reduceat(part[order] & 0xFFFFFFFF, begin, 0).astype(object)
                total[p, to[order][begin], :1 + len(cuts[p])] += np.concatenate([n[:, None].astype(object), value], 1)
                needs[p] += np.bincount(batch.column(f"need{p}").to_numpy(), minlength=BEYOND + 1)
        p, e, i = np.nonzero(total)
        v = [int(t) for t in total[p, e, i]]
        q, z = np.nonzero(needs)
        cols = [np.concatenate([p, q]), np.concatenate([e, z]), np.concatenate([i, np.full(len(q), -1)])]
        yield pa.record_batch([*[pa.array(c, pa.int32()) for c in cols],
                               pa.array([t >> 32 for t in v] + [0] * len(q), pa.int64()),
                               pa.array([t & 0xFFFFFFFF for t in v] + needs[q, z].tolist(), pa.int64())],
                              ["part", "entry", "pos", "high", "low"])

    seen = state.select("x", *[f"{c}{p}" for p in range(PARTS) for c in ("best", "need")])
    got = (seen.mapInArrow(run, "part int, entry int, pos int, high long, low long")
           .groupBy("part", "entry", "pos").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toArrow())
    total = np.zeros((PARTS, k, 1 + max(map(len, cuts))), object)
    needs: list[dict[int, int]] = [{} for _ in range(PARTS)]
    for r in got.to_pylist():
        if r["pos"] < 0:
            needs[r["part"]][r["entry"]] = r["low"]
        else:
            total[r["part"], r["entry"], r["pos"]] = (r["high"] << 32) + r["low"]
    out = []
    for p, book in enumerate(books):
        count, new = total[p, :, :1], book.entries.astype(object)
        used = count[:, 0] > 0
        new[used] = total[p, used, 1:1 + len(cuts[p])] // count[used]
        new = new.astype(np.int64)
        step = new.astype(object) - book.entries.astype(object)
        moved = up(np.sqrt((step * step).sum(1).astype(np.float64))) if new.shape[1] else np.zeros(k)
        out.append(Book(new, book.most, moved, _listed(needs[p], book.listed, k)))
    return out


def _listed(needs: dict[int, int], now: int, entries: int) -> int:
    """How many entries to list next."""
    n, beyond = sum(needs.values()), needs.get(BEYOND, 0)
    if n and beyond < n and 8 * beyond > n:
        return min(2 * now, max(1, entries // 8))
    inner, seen = {z: c for z, c in needs.items() if z != BEYOND}, 0
    for z in sorted(inner):
        seen += inner[z]
        if 100 * seen >= 99 * sum(inner.values()):
            return max(LISTED // 2, min(now, z))
    return now


def encode(vectors: DataFrame, factor: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, codebooks) of every usable vector.

    ``code`` holds an index a part, ``codebooks`` all final entries' components
    as decimal numbers by part, entry and place, joined by commas.
    """
    every = integer_vectors(vectors, factor, id_col, vec_col, label_col)
    label = every.schema["label"].dataType.simpleString()
    out = every.sparkSession.createDataFrame([], f"vec_id long, label {label}, code array<int>, error long,"
                                                 " codebooks string")
    for dim, kind, most in ranges(every):
        own = every.where(F.size("x") == dim).select("id", "label", F.col("x").cast(f"array<{kind}>").alias("x"))
        out = out.unionByName(_encode(own, dim, kind, max(1, most), label))
    return out


def _encode(own: DataFrame, dim: int, kind: str, most: int, label: str) -> DataFrame:
    spark = own.sparkSession
    cuts = np.array_split(np.arange(dim), PARTS)
    least = own.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(ENTRIES).collect()
    start = np.array([r["x"] for r in least], np.int64).reshape(len(least), dim)
    books = [Book(start[:, c], most) for c in cuts]
    state, path = own, None
    for turn in range(ROUNDS):
        to = write_out(_round(state, spark.sparkContext.broadcast(books), dim, kind, label, turn == 0), f"codes-{turn}")
        if path:
            discard(spark, path)
        path, state = to, read_back(spark, to)
        books = _moved(state, books, dim)
    sent = spark.sparkContext.broadcast(books)

    def finish(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                x, code, error = matrix(batch.column("x"), dim), [], np.zeros(batch.num_rows, object)
                for p, book in enumerate(sent.value):
                    part = x[:, cuts[p]]
                    b, _ = assign(part, book, _known(batch, p))
                    code.append(b.best)
                    error += book.some(part.astype(book.kind), b.best[:, None])[:, 0].astype(object)
                flat = np.stack(code, 1).astype(np.int32)
                yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(list(flat)),
                                       pa.array([int(e) for e in error], pa.int64())],
                                      ["vec_id", "label", "code", "error"])

    books_text = ",".join(str(v) for b in books for v in b.entries.ravel().tolist())
    return (state.mapInArrow(finish, f"vec_id long, label {label}, code array<int>, error long")
            .withColumn("codebooks", F.lit(books_text)))


def codes(vectors: DataFrame, factor: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
          label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), code as two hex digits an index."""
    path = write_out(encode(vectors, factor, id_col, vec_col, label_col).withColumn(
        "codebooks", F.sha2("codebooks", 256)), "codes")
    done = read_back(vectors.sparkSession, path)
    by = done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    each = done.join(small(by, F.lit(64)), F.col("label").eqNullSafe(F.col("of")))
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return each.select("vec_id", digits.alias("code"), "error", "label_error",
                       F.col("codebooks").alias("codebooks_sha256"))
