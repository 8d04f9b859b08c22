"""Exact n-gram Jaccard join in the metric space of shingle sets (operator 2).

Pivots are the points {s}, one per shingle, under one order of all shingles.
A document's Voronoi region is that of its first shingle; by the triangle
inequality a document within the radius may lack only so many of its shingles,
so a document is replicated to the regions of its first |A| - ceil(t |A|) + 1
shingles (its window), and two linked documents always meet in a region.
(Whole documents as pivots would put all unrelated documents at distance one
from all pivots, in one region; points keep regions small.)

Regions are joined recursively.  Documents with equal sets are one class from
the start.  Shingles that many classes hold make large regions; they go to
the end of the order, the documents concerned get new windows of rarer
shingles, and what is then left in large regions is divided once more by all
the shingles its documents share.  Regions that are large even then are groups
of near copies: in each round a region's pivot document is held against its
members (a star, never all pairs), and members that end in one component need
no further comparison.  Regions of up to ``SMALL`` classes in different
components are compared in full, and larger ones, should any remain after all
rounds, in full as well.  Before two sets are compared, the parities of their
shingles in 256 buckets bound their difference from below, and the shingles
that their windows share bound their intersection from above; neither bound
drops a link.  Every link used is verified on the whole sets, and no pair of
different components that shares a region is left undecided, so components
are exact.

Defined cases: a null or empty text, or one of blanks, has no shingles and
links with nothing; a null id is the smallest; repeated rows are copies of one
set; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import MOVES, components, freeing, stored
from lintel.llm.shingles import shingle_hashes

SMALL = 64          # classes of a region that is compared in full
BROADCAST_ROWS = 1 << 21     # ids (8 bytes each) that may go to every task
PAIRS = 1 << 11     # pairs of whole sets that one task compares at least
STARS = 4           # star rounds before and after the small regions
BITS = ["b0", "b1", "b2", "b3"]     # parities of the shingles in 256 buckets
ROWS = 256
SIGNED = np.int64


def window_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def spare(p: int) -> int:
    """Shingles kept beyond a window of ``p``, to stand in for those that go to the order's end."""
    return 8 + p // 4


def parities(s: np.ndarray) -> np.ndarray:
    """Four 64-bit words: whether each of 256 buckets holds an odd number of the shingles."""
    odd = (np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
    return np.packbits(odd).view(SIGNED)


def signatures(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, n, key, lead, th, b0..b3): ``key`` names the set, ``lead`` holds its first shingles."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      F.xxhash64(F.col(text_col)).alias("th"))

    @freeing
    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                n, keys, lead, bits = [], [], [], []
                for t in part.column(1).to_pylist():
                    s = shingle_hashes(t, words)
                    p = window_size(len(s), num, den)
                    n.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    lead.append(s[:p + spare(p)].tobytes())
                    bits.append(parities(s))
                bits = np.array(bits, SIGNED).reshape(len(n), len(BITS))
                ids = pa.array(range(uid, uid + len(n)), pa.int64())
                uid += len(n)
                yield pa.record_batch([ids, part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                                       pa.array(lead, pa.binary()), part.column(2), *map(pa.array, bits.T.copy())],
                                      ["uid", "doc_id", "n", "key", "lead", "th", *BITS])

    return src.mapInArrow(run, "uid long, doc_id long, n long, key binary, lead binary, th long, "
                               + ", ".join(f"{b} long" for b in BITS))


def _fetch(rows: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The ``rows`` named in the stored ``ids``, which go along if they are few and else meet by a shuffle."""
    few = ids.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, on, "left_semi")


def _sets(docs: DataFrame, sig: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(uid, n, set): whole sets, as bytes, of the classes in the stored ``ids`` (uid)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"),
                      F.col(text_col).alias("text"))
    wanted = stored(_fetch(sig.select("uid", F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")), ids, ["uid"]),
                    "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    @freeing
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                sets = [shingle_hashes(t, words) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array([s.tobytes() for s in sets], pa.binary())], ["uid", "n", "set"])

    met = src.join(few, src["doc_id"].eqNullSafe(few["w_id"]) & (src["th"] == few["w_th"]))
    return met.select("uid", "text").mapInArrow(run, "uid long, n long, set binary")


def _pairwise(pairs: DataFrame, values: DataFrame, keeps, tasks: int) -> DataFrame:
    """The pairs (a, b) whose values (uid, n, v: bytes) pass ``keeps(n, v, n, v)``, by so many tasks at most."""
    @freeing
    def run(batches):
        for batch in batches:
            hit = [keeps(*r) for r in zip(*[batch.column(c).to_pylist() for c in ("na", "va", "nb", "vb")])]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    one = values.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("v").alias("va"))
    two = values.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "na", "va", "nb", "vb")
            .coalesce(tasks).mapInArrow(run, "a long, b long"))


def _ceil(x: str, num: int, den: int) -> str:
    """SQL of the whole number from num * x / den upwards."""
    return f"(({num} * ({x}) + {den - 1}) div {den})"


class _Join:
    """The rounds over the regions' members (s, uid, n, c, b0..b3)."""

    def __init__(self, sets_of, num: int, den: int):
        self.sets_of, self.num, self.den = sets_of, num, den
        self.comp = None

    def labelled(self, members: DataFrame) -> DataFrame:
        """Members of regions that hold more than one component, with their label.

        A region (of ``c`` members) is settled if all its members are in one
        component, so only members that have links are looked at.
        """
        members = members.drop("label")
        if self.comp is None:
            return members.withColumn("label", F.col("uid"))
        comp = self.comp.withColumnRenamed("node", "uid")
        comp = F.broadcast(comp) if comp.count() <= MOVES else comp
        linked = members.join(comp, "uid")
        settled = stored(linked.groupBy("s", "c").agg(F.count("*").alias("k"), F.min("component_id").alias("lo"),
                                                      F.max("component_id").alias("hi"))
                         .where("k = c and lo = hi").select("s"), "settled", members.count())
        x = members.join(comp, "uid", "left").withColumn("label", F.coalesce("component_id", "uid"))
        few = settled.count()
        if few:
            mixed = x.where("component_id is not null").join(F.broadcast(settled) if few <= BROADCAST_ROWS else settled,
                                                             "s", "left_anti")
            x = x.where("component_id is null").unionByName(mixed)
        return x.drop("component_id")

    def may(self, a: str, b: str):
        """Whether classes of different components (columns with these prefixes) may be within the radius."""
        n, both = f"{a}n + {b}n", _ceil(f"{a}n + {b}n", self.num, self.num + self.den)
        apart = " + ".join(f"bit_count({a}{x} ^ {b}{x})" for x in BITS)
        return F.expr(f"{a}label <> {b}label and {self.den} * least({a}n, {b}n) >= {self.num} * greatest({a}n, {b}n) "
                      f"and {apart} <= {n} - 2 * {both}")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the stored pairs whose sets are within the radius."""
        num, den = self.num, self.den

        def near(na, va, nb, vb):
            x, y = np.frombuffer(va, np.uint64), np.frombuffer(vb, np.uint64)
            both = na + nb - len(np.union1d(x, y))
            return den * both >= num * (na + nb - both)

        count = pairs.count()
        ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "ids", 2 * count)
        return _pairwise(pairs, stored(self.sets_of(ids), "sets").select("uid", "n", F.col("set").alias("v")), near,
                         -(-count // PAIRS))

    def add(self, pairs: DataFrame, rows: int | None = None) -> bool:
        """Verify pairs (a, b), at most ``rows``, take the links in and say whether there were any."""
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs",
                       rows)
        if pairs.isEmpty():
            return False
        found = stored(self.verified(pairs), "links")
        if found.isEmpty():
            return False
        if self.comp is not None:   # of earlier links, one per member of a component
            found = found.unionByName(self.comp.where("node <> component_id").select(
                F.col("node").alias("a"), F.col("component_id").alias("b")))
        self.comp = components(found, rows=found.count())
        return True

    def star(self, x: DataFrame, turn: int) -> bool:
        """Hold each region's pivot document against its members."""
        lead = x.groupBy("s").agg(F.min(F.struct(F.xxhash64("uid", F.lit(turn)).alias("h"), "uid", "n", "label", *BITS))
                                  .alias("p"))
        rows = x.count()
        lead = stored(lead.select("s", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("uid", "n", "label", *BITS)]),
                      "pivots", rows)
        few = lead.count() <= BROADCAST_ROWS // 8
        pairs = (x.select("s", *[F.col(c).alias(f"m_{c}") for c in ("uid", "n", "label", *BITS)])
                 .join(F.broadcast(lead) if few else lead, "s").where(self.may("p_", "m_"))
                 .select(F.col("p_uid").alias("a"), F.col("m_uid").alias("b")))
        return self.add(pairs, rows)

    def full(self, x: DataFrame, large: DataFrame | None = None) -> None:
        """Compare the members of different components.

        Pairs that share too few of their windows' shingles, counting every
        ``large`` region (uid, h) that could hold both, cannot be within the
        radius: of the window that ends first, the rest of its set can add
        only so many.
        """
        if large is not None:
            x = x.join(large, "uid", "left").fillna(0, ["h"])
        else:
            x = x.withColumn("h", F.lit(1 << 40))
        both = _ceil("na + nb", self.num, self.num + self.den)
        need = f"{both} + 1 - greatest({_ceil('na', self.num, self.den)}, {_ceil('nb', self.num, self.den)})"
        own = ("uid", "n", "label", "h", *BITS)
        a, b = (x.select("s", *[F.col(c).alias(f"{k}_{c}") for c in own]) for k in "ab")
        met = (a.join(b, "s").where((F.col("a_uid") < F.col("b_uid")) & self.may("a_", "b_"))
               .groupBy(F.col("a_uid").alias("a"), F.col("b_uid").alias("b"))
               .agg(F.count("*").alias("c"), F.first("a_n").alias("na"), F.first("b_n").alias("nb"),
                    F.first(F.least("a_h", "b_h")).alias("h")))
        self.add(met.where(F.expr(f"c + h >= {need}")).select("a", "b"))


def _frequent(rows: DataFrame) -> DataFrame:
    """The shingles (s) of more than ``SMALL`` rows."""
    return rows.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") > SMALL).select("s")


def _exploded(rows: DataFrame) -> DataFrame:
    """(uid, s) of every shingle in the column ``lead`` (bytes)."""
    @freeing
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                sets = [np.frombuffer(v, SIGNED) for v in part.column(1).to_pylist()]
                lens = [len(v) for v in sets]
                yield pa.record_batch([pa.array(np.repeat(part.column(0).to_numpy(), lens)),
                                       pa.array(np.concatenate(sets))], ["uid", "s"])

    return rows.select("uid", "lead").mapInArrow(run, "uid long, s long")


def _held(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _ordered(rows: DataFrame, late: DataFrame | None, num: int, den: int) -> DataFrame:
    """(s, uid, n, short): windows of ``rows`` (uid, n, lead) with the stored ``late`` shingles (s) at the order's end.

    Where ``lead`` is not the whole set and holds too few other shingles, one
    row with ``short`` stands for the window.
    """
    known = None
    if late is None:
        rows = rows.select("uid", "n", "lead", F.lit(None).cast("array<bigint>").alias("late"))
    elif late.count() <= BROADCAST_ROWS // 4:     # the frequent shingles go along
        known = rows.sparkSession.sparkContext.broadcast(np.sort(np.array([r["s"] for r in late.collect()], SIGNED)))
        rows = rows.select("uid", "n", "lead", F.lit(None).cast("array<bigint>").alias("late"))
    else:                                         # else they meet the shingles in a join
        held = _exploded(rows).join(late, "s").groupBy("uid").agg(F.collect_set("s").alias("late"))  # bounded by lead
        rows = rows.join(held, "uid", "left").select("uid", "n", "lead", "late")

    @freeing
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                leads = [np.frombuffer(v, SIGNED) for v in part.column(2).to_pylist()]
                ends = np.cumsum([len(v) for v in leads])
                if known is not None:
                    last = np.split(_held(np.concatenate(leads), known.value), ends[:-1])
                else:
                    last = [np.isin(v, np.array(own or (), SIGNED)) for v, own in zip(leads, part.column(3).to_pylist())]
                wins, short = [], []
                for n, v, away in zip(part.column(1).to_pylist(), leads, last):
                    p = window_size(n, num, den)
                    w = v[~away][:p]
                    if len(w) < p and len(v) == n:
                        w = np.concatenate([w, v[away]])[:p]
                    short.append(len(w) < p)
                    wins.append(np.zeros(1, SIGNED) if short[-1] else w)
                lens = [len(w) for w in wins]
                yield pa.record_batch([pa.array(np.concatenate(wins)), *[pa.array(np.repeat(x, lens)) for x in (
                    part.column(0).to_numpy(), part.column(1).to_numpy(), np.array(short, bool))]],
                    ["s", "uid", "n", "short"])

    return rows.mapInArrow(run, "s long, uid long, n long, short boolean")


def jaccard_classes(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(uid, doc_id, th, n_shingles, component_id, first) of every row of ``docs``.

    Rows link when ``den * |A & B| >= num * |A | B|`` over their sets of
    ``words``-word shingles; component_id is the smallest id reachable and ``first`` marks
    one row of each component that has it; ``th`` is the text's hash.
    """
    sig = stored(signatures(docs, words, num, den, id_col, text_col), "signatures")
    rep = stored(sig.where("n > 0").groupBy("key").agg(F.min("uid").alias("uid")), "classes", sig.count())
    one = _fetch(sig, rep.select("uid"), ["uid"])

    def sets_of(ids: DataFrame) -> DataFrame:
        return _sets(docs, sig, ids, words, id_col, text_col)

    def windows(late: DataFrame) -> DataFrame:
        """(s, uid, n) of every class; whole sets are read only where the kept shingles do not suffice."""
        out, names = stored(_ordered(one, late, num, den), "windows"), ["s", "uid", "n"]
        short = stored(out.where("short").select("uid"), "short")
        if short.isEmpty():
            return out.select(names)
        whole = sets_of(short).select("uid", "n", F.col("set").alias("lead"))
        return out.where("not short").select(names).unionByName(
            stored(_ordered(whole, late, num, den).select(names).distinct(), "windows", 32 * short.count()))

    late = stored(_frequent(_ordered(one, None, num, den)), "late")
    wins = windows(late)
    large = stored(_frequent(wins), "large")
    if not large.isEmpty():
        moved = stored(_fetch(wins, large, ["s"]).select("uid").distinct(), "moved", sig.count())
        often = _frequent(_exploded(sets_of(moved).select("uid", F.col("set").alias("lead"))))
        late = stored(late.unionByName(large).unionByName(often).distinct(), "late")
        wins = windows(late)
    more = wins.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    members = stored(wins.join(more, "s").join(one.select("uid", *BITS), "uid"), "members", wins.count())

    run = _Join(sets_of, num, den)
    small, large = members.where(F.col("c") <= SMALL), stored(members.where(F.col("c") > SMALL), "large")

    def stars(x: DataFrame, first: int) -> DataFrame:
        """The members of mixed regions that are left after star rounds."""
        for turn in range(first, first + STARS):
            x = stored(run.labelled(x), "mixed")
            if x.isEmpty():
                return x
            if not run.star(x, turn):
                return x
        return stored(run.labelled(x), "mixed")

    large = stars(large, 0)
    run.full(run.labelled(small), large.groupBy("uid").agg(F.count("*").alias("h")))
    large = stars(large, STARS)
    if not large.isEmpty():
        run.full(large)
    own = sig.select("uid", "doc_id", "th", F.col("n").alias("n_shingles"), "key")
    classes = own.where("n_shingles > 0").join(rep.select("key", F.col("uid").alias("label")), "key")
    if run.comp is not None:
        classes = (classes.join(run.comp.withColumnRenamed("node", "label"), "label", "left")
                   .withColumn("label", F.coalesce("component_id", "label")).drop("component_id"))
    least = classes.groupBy("label").agg(F.min(F.struct("doc_id", "uid")).alias("m"))
    out = ["uid", "doc_id", "th", "n_shingles"]
    linked = classes.join(least, "label").select(*out, F.col("m.doc_id").alias("component_id"),
                                                 (F.col("m.uid") == F.col("uid")).alias("first"))
    alone = own.where("n_shingles = 0").select(*out, F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with all their columns.

    Rows without shingles stay; of rows that repeat an id and a text one stays.
    """
    first = (jaccard_classes(docs, words, num, den, id_col, text_col).where("first")
             .groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
             .agg(F.max(F.col("n_shingles") > 0).alias("_once")))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{text_col}`").alias("th"))
    met = rows.join(first, rows["id"].eqNullSafe(first["_id"]) & (rows["th"] == first["_th"]))
    turn = F.row_number().over(Window.partitionBy("id", "th").orderBy("id"))
    return (met.withColumn("turn", turn).where("not _once or turn = 1")
            .select(*[F.col(f"row.`{c}`").alias(c) for c in names]))
