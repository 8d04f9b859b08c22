"""Rolling-origin validation from cumulative moments.

One aggregate by period gives the sums and products of every period; running
totals over the periods give the moments before every cutoff, and each is
solved by a sweep.  So the fits of all cutoffs cost one scan.  With two fixed
effects the same holds for the sums by period and group: on a balanced panel
the demeaned products are the total ones without those between the groups.
Values are taken from the overall mean first, so that products lose nothing to
their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators import sweep
from lintel.operators.joins import attach_scalars


def _complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    for c in names:
        df = df.filter(F.col(c).isNotNull())
    return df


def _shifted(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with ``_z``: the values less their overall means, and ``_shift``."""
    shift = df.agg(F.array(*[F.avg(c) for c in names]).alias("_shift"))
    return attach_scalars(df, shift).withColumn("_z", F.array(*[F.col(c) - F.col("_shift")[i]
                                                               for i, c in enumerate(names)]))


def _running(df: DataFrame, period: str, size: int, by: Sequence[str] = (), products: bool = False) -> DataFrame:
    """(by, period, n, total, product): sums of ``_z`` over the periods before each one.

    ``product`` holds the sums of products when asked for.  Every group has a
    row at every period that occurs.
    """
    pairs = [(i, j) for i in range(size) for j in range(i, size)] if products else []
    sums = [F.sum(F.col("_z")[i]).alias(f"t{i}") for i in range(size)]
    sums += [F.sum(F.col("_z")[i] * F.col("_z")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    own = df.groupBy(period, *by).agg(F.count(F.lit(1)).alias("n"), *sums)
    grid = df.select(period).distinct()
    if by:
        grid = grid.crossJoin(df.select(*by).distinct())          # groups times periods: of the result's size
    w = Window.partitionBy(*by).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    every = grid.join(own, [period, *by], "left")

    def before(c: str) -> Column:
        return F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(w), F.lit(0)).alias(c)

    run = every.select(period, *by, *[before(c) for c in own.columns if c not in (period, *by)])
    cols = [F.col("n"), F.array(*[F.col(f"t{i}").cast("double") for i in range(size)]).alias("total")]
    if products:
        cols.append(F.array(*[F.array(*[F.col(f"p{min(i, j)}_{max(i, j)}").cast("double") for j in range(size)])
                              for i in range(size)]).alias("product"))
    return run.select(period, *by, *cols)


def _outer(total: Column, n: Column) -> Column:
    """total total' / n, nothing where n is 0."""
    return F.transform(total, lambda a: F.transform(total, lambda b: F.when(n > 0, a * b / n).otherwise(0.0)))


def _less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.zip_with(p, q, lambda x, y: x - y))


def fits(df: DataFrame, y: str, xs: Sequence[str], period: str) -> DataFrame:
    """A model row (of :func:`sweep.solve`) for every period, trained on the ones before it."""
    names = [*xs, y]
    z = _shifted(_complete(df, names), names)
    run = _running(z, period, len(names), products=True).where("n > 0")
    run = attach_scalars(run, z.select("_shift").limit(1))
    mean = F.zip_with("total", "_shift", lambda t, s: t / F.col("n") + s)
    moment = run.select(period, "n", mean.alias("mean"),
                        _less(F.col("product"), _outer(F.col("total"), F.col("n"))).alias("cross"))
    return sweep.solve(moment, len(xs))


def _by_period(rows: DataFrame, actual: str, raw: str, period: str) -> DataFrame:
    def rmse(a: str, b: str) -> Column:
        return F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))))
    return rows.groupBy(period).agg(F.first("n").alias("n_train"), F.count(F.lit(1)).alias("n_test"),
                                    rmse(actual, raw).alias("rmse_raw"), rmse(actual, "fit").alias("rmse_fit"))


def validate(df: DataFrame, y: str, xs: Sequence[str], period: str, raw: str) -> DataFrame:
    """(period, n_train, n_test, rmse_raw, rmse_fit) of every period predicted from the ones before it.

    Periods whose training rows leave no degree of freedom have no row.
    """
    rows = _complete(df, [*xs, y])
    model = fits(df, y, xs, period).where("df_resid > 0").select(period, "n", "coef", "intercept")
    fit = F.col("intercept")
    for i, x in enumerate(xs):
        fit = fit + F.coalesce(F.col("coef")[i], F.lit(0.0)) * F.col(x)
    return _by_period(rows.join(F.broadcast(model), period).withColumn("fit", fit), y, raw, period)


def validate_two_way(df: DataFrame, y: str, xs: Sequence[str], g1: str, g2: str, period: str, raw: str) -> DataFrame:
    """As :func:`validate`, with effects of ``g1`` and ``g2``; also ``balanced``, without which a fit does not hold."""
    names = [*xs, y]
    k, size = len(xs), len(names)
    z = _shifted(_complete(df, names), names)
    every = _running(z, period, size, products=True)
    one, two = (_running(z, period, size, by=[g]) for g in (g1, g2))

    def between(run: DataFrame, name: str) -> DataFrame:
        """Products of the groups' totals, and how many groups there are."""
        cell = [F.sum(F.when(F.col("n") > 0, F.col("total")[i] * F.col("total")[j] / F.col("n")).otherwise(0.0))
                for i in range(size) for j in range(size)]
        got = run.groupBy(period).agg(F.count(F.when(F.col("n") > 0, 1)).alias(f"groups_{name}"),
                                      *[c.alias(f"c{i}") for i, c in enumerate(cell)])
        return got.select(period, f"groups_{name}", F.array(*[F.array(*[F.col(f"c{i * size + j}") for j in range(size)])
                                                            for i in range(size)]).alias(f"between_{name}"))

    run = every.join(between(one, "1"), period).join(between(two, "2"), period).where("n > 0")
    within = F.zip_with(_less(_less(F.col("product"), F.col("between_1")), F.col("between_2")),
                        _outer(F.col("total"), F.col("n")), lambda p, q: F.zip_with(p, q, lambda a, b: a + b))
    periods = z.select(period).distinct()
    count = periods.select(period, (F.row_number().over(Window.orderBy(period)) - 1).alias("periods"))
    moment = run.join(count, period).select(
        period, "n", "total", "groups_1", "groups_2", F.transform(F.col("total"), lambda t: F.lit(0.0)).alias("mean"),
        within.alias("cross"), (F.col("n") == F.col("groups_1") * F.col("groups_2") * F.col("periods")).alias("balanced"))
    # the raw total sum of squares only enters R², which is not used here
    model = (sweep.solve(moment, k, absorbed=F.col("groups_1") + F.col("groups_2") - 1)
             .where("df_resid > 0").select(period, "n", "coef", "total", "balanced"))
    rows = (z.join(F.broadcast(model), period)
            .join(one.select(period, g1, F.col("n").alias("n1"), F.col("total").alias("total1")), [period, g1])
            .join(two.select(period, g2, F.col("n").alias("n2"), F.col("total").alias("total2")), [period, g2]))

    def offset(i: int) -> Column:
        """The effects' part of a shifted column."""
        return (F.col("total1")[i] / F.nullif(F.col("n1"), F.lit(0)) + F.col("total2")[i] / F.nullif(F.col("n2"), F.lit(0))
                - F.col("total")[i] / F.col("n"))

    fit = offset(k) + F.col("_shift")[k]
    for i in range(k):
        fit = fit + F.coalesce(F.col("coef")[i], F.lit(0.0)) * (F.col("_z")[i] - offset(i))
    out = _by_period(rows.withColumn("fit", fit), y, raw, period)
    return out.join(model.select(period, "balanced"), period)
