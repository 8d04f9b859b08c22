"""Two-way fixed effects on panels with missing cells.

The rows are reduced once to cells (a count and sums for each pair of groups
that occurs); alternating demeaning then runs on the cells: the effects of one
grouping are the mean of what the other leaves, in turn, each step an
aggregate that is stored, until nothing moves by more than ``TOL`` standard
deviations.  Degrees of freedom follow from the connected components of the
graph whose edges are the cells (an effect a component is redundant).  A row's
leverage comes from the reduced system of the second grouping, the smaller
one: its matrix is one row, inverted by the sweep, which leaves out one group
a component.

Defined cases: rows with a NULL group, value or regressor do not train; a pair
of groups of different components has no estimate; so has a group unseen in
training.  The second grouping may have ``GROUPS`` groups, beyond which
:func:`leverages` raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators import sweep
from lintel.operators.joins import attach_scalars
from lintel.session import written

TOL = 1e-10
STEPS = 4            # alternations between two stored tables
ROUNDS = 250
GROUPS = 500


def cells(train: DataFrame, cols: Sequence[str], g1: str, g2: str) -> DataFrame:
    """(g1, g2, n, sums of ``cols``) of every pair of groups that occurs."""
    return written(train.groupBy(F.col(g1).alias("g1"), F.col(g2).alias("g2")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]), "cells")


def _mean_of_rest(cell: DataFrame, own: str, other: str, effects: DataFrame, k: int) -> DataFrame:
    """(own, e0 ..): means over ``own`` of what the ``other`` grouping's effects leave."""
    each = cell.join(effects, other)
    total = [F.sum(F.col(f"s{i}") - F.col("n") * F.col(f"e{i}")) / F.sum("n") for i in range(k)]
    return each.groupBy(own).agg(*[t.alias(f"e{i}") for i, t in enumerate(total)])


def effects(cell: DataFrame, scale: Sequence[float], tol: float = TOL) -> tuple[DataFrame, DataFrame]:
    """(g1, e0 ..) and (g2, e0 ..): the effects of all columns, by alternating means.

    ``scale`` holds a standard deviation a column.
    """
    k = len(scale)
    two = written(cell.select("g2").distinct().select("g2", *[F.lit(0.0).alias(f"e{i}") for i in range(k)]), "effects")
    for _ in range(ROUNDS):
        new = two
        for _ in range(STEPS):
            one = _mean_of_rest(cell, "g1", "g2", new, k)
            new = _mean_of_rest(cell, "g2", "g1", one, k)
        new = written(new, "effects")
        old = two.toDF("g2", *[f"o{i}" for i in range(k)])
        moved = new.join(old, "g2").agg(*[F.max(F.abs(F.col(f"e{i}") - F.col(f"o{i}"))) for i in range(k)]).first()
        two = new
        if all((m or 0.0) <= tol * (s or 1.0) for m, s in zip(moved, scale)):
            return written(_mean_of_rest(cell, "g1", "g2", two, k), "effects"), two
    raise RuntimeError(f"alternating means did not settle in {ROUNDS * STEPS} steps")


def components(cell: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g1, part) and (g2, part): the smallest ``g1`` that each group is connected with."""
    edge = cell.select("g1", "g2")
    one = written(edge.select("g1").distinct().withColumn("part", F.col("g1")), "parts")
    while True:
        two = written(edge.join(one, "g1").groupBy("g2").agg(F.min("part").alias("part")), "parts")
        new = written(edge.join(two, "g2").groupBy("g1").agg(F.min("part").alias("part")), "parts")
        moved = not new.join(one.withColumnRenamed("part", "was"), "g1").where("part <> was").isEmpty()
        one = new
        if not moved:
            return one, two


def leverages(cell: DataFrame) -> DataFrame:
    """(g1, g2, h): the effects' part of a row's leverage, for all pairs of groups."""
    size = cell.select("g2").distinct().count()
    if size > GROUPS:
        raise ValueError(f"{size} groups in the second grouping, {GROUPS} at most")
    share = cell.join(cell.groupBy("g1").agg(F.sum("n").alias("n1")), "g1").select(
        "g1", "g2", "n", "n1", (F.col("n") / F.col("n1")).alias("p"))
    both = share.select("g1", F.col("g2").alias("u"), F.col("n").alias("nu")).join(share, "g1")
    entry = both.groupBy("u", F.col("g2").alias("t")).agg(
        (F.sum(F.when(F.col("u") == F.col("g2"), F.col("n")).otherwise(0)) - F.sum(F.col("nu") * F.col("p"))).alias("v"))
    names = cell.select("g2").distinct().agg(F.sort_array(F.collect_list("g2")).alias("names"))      # GROUPS at most
    grid = names.select(F.explode("names").alias("u"), "names").select("u", F.explode("names").alias("t"))
    full = grid.join(entry, ["u", "t"], "left").select("u", "t", F.coalesce("v", F.lit(0.0)).alias("v"))
    row = full.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("r"))
    matrix = row.agg(F.sort_array(F.collect_list(F.struct("u", F.col("r.v").alias("v")))).alias("m"))
    swept = (matrix.select(F.col("m.u").alias("names"), sweep.sweep(F.col("m.v"), size).alias("s"))
             .select("names", F.posexplode("s.m").alias("i", "r"), F.col("s.used").alias("used"))
             .select("names", "used", "i", F.posexplode("r").alias("j", "v")))
    inverse = written(swept.select(F.col("names")[F.col("i")].alias("u"), F.col("names")[F.col("j")].alias("t"),
                                   F.when(F.col("used")[F.col("i")] & F.col("used")[F.col("j")], -F.col("v"))
                                   .otherwise(0.0).alias("v")), "inverse")
    q = (share.join(inverse.withColumnRenamed("t", "of"), share["g2"] == F.col("u"))
         .groupBy("g1", F.col("of").alias("t")).agg(F.sum(F.col("p") * F.col("v")).alias("q")))
    q = written(q, "reduced")
    r = (share.select("g1", F.col("g2").alias("t"), "p", "n1").join(q, ["g1", "t"])
         .groupBy("g1").agg(F.sum(F.col("p") * F.col("q")).alias("r"), F.first("n1").alias("n1")))
    own = inverse.where(F.col("u") == F.col("t")).select("t", "v")
    return q.join(r, "g1").join(own, "t").select(
        "g1", F.col("t").alias("g2"), (1 / F.col("n1") + F.col("v") - 2 * F.col("q") + F.col("r")).alias("h"))


class Fit:
    """A fitted panel: the model row (of :func:`sweep.solve`), effects, components and cells."""

    def __init__(self, df: DataFrame, y: str, xs: Sequence[str], g1: str, g2: str):
        self.names, self.k, self.g1, self.g2 = [*xs, y], len(xs), g1, g2
        train = df
        for c in [*self.names, g1, g2]:
            train = train.filter(F.col(c).isNotNull())
        self.cell = cells(train, self.names, g1, g2)
        spread = train.agg(*[F.stddev_pop(c) for c in self.names], F.var_pop(y) * F.count(F.lit(1))).first()
        self.one, self.two = effects(self.cell, spread[:-1])
        self.part1, self.part2 = components(self.cell)
        groups = [d.count() for d in (self.part1, self.part2)] + [self.part1.select("part").distinct().count()]
        self.absorbed = groups[0] + groups[1] - groups[2]
        rows = self.demeaned(train)
        moment = sweep.moments(rows, f"d{self.k}", [f"d{i}" for i in range(self.k)])
        self.model = sweep.solve(moment, self.k, absorbed=self.absorbed, tss=F.lit(float(spread[-1] or 0.0)))
        self.model = self.model.withColumn("absorbed", F.lit(self.absorbed))

    def demeaned(self, rows: DataFrame) -> DataFrame:
        """``rows`` with d0 ..: the columns less both effects (NULL for unseen groups), and ``off``: those of y."""
        n = len(self.names)
        one = self.one.toDF("_g1", *[f"_a{i}" for i in range(n)])
        two = self.two.toDF("_g2", *[f"_b{i}" for i in range(n)])
        out = rows.join(one, rows[self.g1] == F.col("_g1"), "left").join(two, rows[self.g2] == F.col("_g2"), "left")
        d = [(F.col(c) - F.col(f"_a{i}") - F.col(f"_b{i}")).alias(f"d{i}") for i, c in enumerate(self.names)]
        return out.select(*rows.columns, *d, (F.col(f"_a{n - 1}") + F.col(f"_b{n - 1}")).alias("off"))

    def summary(self, names: Sequence[str]) -> DataFrame:
        return sweep.summary(self.model, names, intercept=False)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with fit, lwr and upr."""
        keep = rows.columns
        h = leverages(self.cell).toDF("_h1", "_h2", "h")
        part1, part2 = self.part1.toDF("_p1", "_part1"), self.part2.toDF("_p2", "_part2")
        out = self.demeaned(rows)
        out = (out.join(h, (F.col(self.g1) == F.col("_h1")) & (F.col(self.g2) == F.col("_h2")), "left")
               .join(part1, F.col(self.g1) == F.col("_p1"), "left").join(part2, F.col(self.g2) == F.col("_p2"), "left"))
        out = attach_scalars(out, self.model.select("coef", "cov", "s2", "tq"))
        d = [F.col(f"d{i}") for i in range(self.k)]
        fit = F.col("off")
        for i, x in enumerate(d):
            fit = fit + F.coalesce(F.col("coef")[i], F.lit(0.0)) * x
        fit = F.when(F.col("_part1") == F.col("_part2"), fit)
        band: Column = F.col("tq") * F.sqrt(F.col("s2") * (F.col("h") + sweep.leverage(d)))
        return out.select(*keep, fit.alias("fit"), (fit - band).alias("lwr"), (fit + band).alias("upr"))
