"""Embedding near-duplicates by product quantisation (operator 9).

Vectors equal in value and label are one class first.  A coarse quantiser and
residual subspace codes are fitted in numpy on a bounded sample (``SAMPLE``
vectors); every class is then indexed: it goes to the inverted list of its
nearest centroid within its label, with the codes of its residual and the
length of what the codes leave out.  Every class probes the lists of its
``PROBES`` nearest centroids: table look-ups give asymmetric distances to the
codes, those within the link radius plus the left-out length (by the triangle
inequality no link of a probed list is lost) are ranked exactly by cosine in
double precision.  A pair counts when either side probes the other's list.

Lists are cut into blocks of at most ``BLOCK`` classes and probes sent to each
block, so a list that holds a third of all rows is many tasks; a block returns
counts and a spanning forest of its links, never its pairs.  Centroids grow
with the input up to a quarter of the sample, and never beyond ``MAX_LISTS``.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components, or whose label is null, links with nothing; vectors of different
length never link; repeated rows are vectors of their own; rows are told apart
by vector and label, so repeated and null ids are harmless, and a component is
named by its smallest id (null if it has none); an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import components, stored

SAMPLE = 20_000
PER_LIST, MAX_LISTS = 128, 65_536
SUBSPACES, CODES = 8, 64
PROBES = 8
BLOCK = 1024
ROUNDS = 8


def kmeans(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from a random start; empty cells keep their centre."""
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest centres of each row, nearest first."""
    out = []
    for a in range(0, len(x), 2048):
        d = (c * c).sum(1)[None] - 2 * (x[a:a + 2048] @ c.T)
        if k >= len(c):
            out.append(np.argsort(d, 1, kind="stable"))
        else:
            p = np.argpartition(d, k - 1, 1)[:, :k]
            out.append(np.take_along_axis(p, np.argsort(np.take_along_axis(d, p, 1), 1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, min(k, len(c))), np.int64)


class Quantiser:
    """Coarse centroids and residual codebooks over unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.dim = x.shape[1]
        self.coarse = kmeans(x, lists).astype(np.float32)
        rest = x - self.coarse[nearest(x, self.coarse, 1)[:, 0]]
        self.cuts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.books = [kmeans(rest[:, c], CODES).astype(np.float32) for c in self.cuts]

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what they leave out."""
        codes = np.stack([nearest(rest[:, c], b, 1)[:, 0] for c, b in zip(self.cuts, self.books)], 1)
        left = rest - np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)[:, self._order()]
        return codes.astype(np.uint8), np.linalg.norm(left, axis=1)

    def _order(self) -> np.ndarray:
        return np.argsort(np.concatenate(self.cuts), kind="stable")

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of query residuals to coded residuals, by table look-up."""
        d = np.zeros((len(rest), len(codes)), np.float32)
        for i, (c, b) in enumerate(zip(self.cuts, self.books)):
            q = rest[:, c]
            table = (q * q).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * q @ b.T
            d += table[:, codes[:, i]]
        return np.sqrt(np.maximum(d, 0))


def _columns(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec, usable)."""
    v = F.col("vec")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(odd, F.lit(True))
              & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec")).withColumn("usable", usable)


def classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
            ) -> DataFrame:
    """(rep, label, vec, first, weight): one row per distinct vector within a label.

    ``rep`` is a row number, to be stored; ``first`` the smallest id.
    """
    u = _columns(vectors, id_col, vec_col, label_col).where("usable")
    return (u.groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
            .withColumn("rep", F.monotonically_increasing_id()))


def links(found: DataFrame, cosine: float, probes: int = PROBES) -> DataFrame:
    """(a, b, n) over classes: spanning links (b not null) and link counts (n) of each class ``a``.

    ``found`` is the stored result of :func:`classes`.
    """
    spark, label = found.sparkSession, found.schema["label"].dataType.simpleString()
    sizes = {r[0]: r[1] for r in found.groupBy(F.size("vec")).count().collect()}   # one row a dimension
    parts = []
    for dim, n in sorted(sizes.items()):
        own = found.where(F.size("vec") == dim)
        luck = F.pmod(F.xxhash64("vec", F.lit("sample")), F.lit(1_000_003)) < int(1_000_003 * min(1, SAMPLE / n)) + 1
        sample = own.where(luck).select("vec").limit(2 * SAMPLE).collect()
        x = np.array(sorted(r["vec"] for r in sample), np.float64)
        q = Quantiser(x, int(min(max(1, n // PER_LIST), MAX_LISTS, max(1, len(x) // 4))))
        parts.append(_probe(own, spark.sparkContext.broadcast(q), n, cosine, probes, label))
    if not parts:
        return spark.createDataFrame([], "a long, b long, n long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _probe(own: DataFrame, sent, n: int, cosine: float, probes: int, label: str) -> DataFrame:
    """Index all of ``own`` and search it."""
    radius = (2 - 2 * cosine) ** 0.5 + 1e-6

    def assign(batches):
        q = sent.value
        for batch in batches:
            x = np.array(batch.column("vec").to_pylist(), np.float64).reshape(batch.num_rows, q.dim)
            near = nearest((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), q.coarse, probes)
            yield pa.record_batch([*batch.columns, pa.array(near[:, 0], pa.int32()),
                                   pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                                  [*batch.schema.names, "home", "probes"])

    at = stored(own.select("label", "rep", "weight", "vec").mapInArrow(
        assign, f"label {label}, rep long, weight long, vec array<double>, home int, probes array<int>"), "index")
    blocks = (at.groupBy("label", "home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
              .withColumnRenamed("home", "cell"))
    base = (at.withColumn("cell", F.col("home")).join(blocks, ["label", "cell"])
            .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("base", F.lit(True)))
    again = at.toDF(*at.columns)   # columns of its own, as both sides come from one table
    asks = (again.withColumn("cell", F.explode("probes")).join(blocks, ["label", "cell"])
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("base", F.lit(False)))
    cols = ["label", "cell", "block", "rep", "weight", "home", "probes", "vec"]

    def search(p: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        if p.empty or asked.empty:
            return none
        q, cell = sent.value, int(p["cell"].iloc[0])
        vb = np.array(p["vec"].tolist(), np.float64)
        nb = np.linalg.norm(vb, axis=1)
        rest = (vb / nb[:, None]).astype(np.float32) - q.coarse[cell]
        codes, left = q.code(rest)
        rb, wb = p["rep"].to_numpy(), p["weight"].to_numpy()
        probed = [set(x) for x in p["probes"]]
        count: dict[int, int] = {}
        root: dict[int, int] = {}
        edges: list[tuple[int, int]] = []

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a in range(0, len(asked), 256):
            part = asked.iloc[a:a + 256]
            vq = np.array(part["vec"].tolist(), np.float64)
            nq = np.linalg.norm(vq, axis=1)
            rq, wq, hq = part["rep"].to_numpy(), part["weight"].to_numpy(), part["home"].to_numpy()
            d = q.distances((vq / nq[:, None]).astype(np.float32) - q.coarse[cell], codes)
            i, j = np.nonzero(d <= radius + left[None] + 1e-3)
            keep = rq[i] != rb[j]
            i, j = i[keep], j[keep]
            hit = np.concatenate([np.einsum("nd,nd->n", vq[i[s:s + 4096]], vb[j[s:s + 4096]])
                                  for s in range(0, len(i), 4096)] or [np.zeros(0)]) / (nq[i] * nb[j]) >= cosine
            for x, y in zip(i[hit].tolist(), j[hit].tolist()):
                ra, rc = int(rq[x]), int(rb[y])
                count[ra] = count.get(ra, 0) + int(wb[y])
                if int(hq[x]) not in probed[y]:      # else the other side finds and counts it too
                    count[rc] = count.get(rc, 0) + int(wq[x])
                u, v = find(ra), find(rc)
                if u != v:
                    root[max(u, v)] = min(u, v)
                    edges.append((ra, rc))
        out = [(a, None, n) for a, n in count.items()] + [(a, b, 0) for a, b in edges]
        if not out:
            return none
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    keys = ["label", "cell", "block"]
    return (base.select(*cols).groupBy(*keys).cogroup(asks.select(*cols).groupBy(*keys))
            .applyInPandas(search, "a long, b long, n long"))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, probes: int = PROBES, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    found = stored(classes(vectors, id_col, vec_col, label_col), "classes")
    got = stored(links(found, cosine, probes), "links")
    count = got.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(got.where("b is not null").select("a", "b"))
    ids = (comp.join(found.select(F.col("rep").alias("node"), "first"), "node")
           .groupBy("component_id").agg(F.min("first").alias("least")))
    comp = comp.join(ids, "component_id").select(F.col("node").alias("rep"), "least")
    each = (found.join(count, "rep", "left").join(comp, "rep", "left")
            .select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"),
                    (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                    F.coalesce("least", "first").alias("component_id")))
    every = _columns(vectors, id_col, vec_col, label_col)
    u = every.where("usable")
    ok = (u.join(each, (u["label"] == each["c_label"]) & (u["vec"] == each["c_vec"]))
          .select(F.col("id").alias("vec_id"), "n_links", "component_id"))
    rest = every.where("not usable").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                                            F.col("id").alias("component_id"))
    return ok.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
