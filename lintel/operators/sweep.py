"""Least squares of any number of regressors by sweeping one moment row.

One aggregate reduces the rows to the matrix of centred cross-products.  The
sweep takes one regressor after another, in order, as an array expression on
that row: a regressor that the ones before it explain (all but ``TOL`` of its
own variation) is not swept and is reported as aliased, with no estimate, so
a collinear column never makes noise of the others.  Works on one model row or
on many (a fit a group, or a fit a cutoff).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.tails import f_p_value, t_p_value, t_quantile
from lintel.operators.joins import attach_scalars

TOL = 1e-10          # of squares: a norm of 1e-5


def moments(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, cross): count, means and centred cross-products of ``xs`` then ``y`` over complete rows."""
    names = [*xs, y]
    for c in names:
        df = df.filter(F.col(c).isNotNull())
    n = F.count(F.lit(1))
    pairs = {(i, j): F.covar_pop(names[i], names[j]) * n for i in range(len(names)) for j in range(i, len(names))}
    got = df.groupBy(*by).agg(n.alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)],
                              *[v.alias(f"_s{i}_{j}") for (i, j), v in pairs.items()])
    size = range(len(names))
    return got.select(*by, "n", F.array(*[F.col(f"_m{i}") for i in size]).alias("mean"),
                      F.array(*[F.array(*[F.col(f"_s{min(i, j)}_{max(i, j)}") for j in size]) for i in size]).alias("cross"))


def sweep(cross: Column, pivots: int, tol: float = TOL) -> Column:
    """Struct (m, used): ``cross`` swept on its first ``pivots`` columns in order.

    Of the swept columns, ``m`` holds minus the inverse, and products with it elsewhere.
    """
    def step(s, j):
        d = s["m"][j][j]
        ok = d > s["scale"][j] * tol
        swept = F.transform(s["m"], lambda row, i: F.transform(row, lambda v, c: (
            F.when((i == j) & (c == j), -1 / d).when((i == j) | (c == j), v / d)
            .otherwise(v - s["m"][i][j] * s["m"][j][c] / d))))
        return F.struct(F.when(ok, swept).otherwise(s["m"]).alias("m"),
                        F.concat(s["used"], F.array(F.coalesce(ok, F.lit(False)))).alias("used"),
                        s["scale"].alias("scale"))

    start = F.struct(cross.alias("m"), F.array().cast("array<boolean>").alias("used"),
                     F.transform(cross, lambda row, i: row[i]).alias("scale"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(pivots - 1)), start, step)


def solve(moment: DataFrame, k: int, absorbed: Column | int = 1, tss: Column | None = None) -> DataFrame:
    """Adds the fit to rows (n, mean, cross) of :func:`moments`.

    ``absorbed`` counts parameters besides the regressors' (1: the intercept);
    ``tss`` is the total sum of squares if it is not that of ``cross``.
    """
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    tss = F.col("cross")[k][k] if tss is None else tss
    out = moment.withColumn("_s", sweep(F.col("cross"), k)).withColumn("_tss", tss)
    out = out.select("*", F.col("_s.m").alias("swept"), F.col("_s.used").alias("used")).drop("_s")
    out = (out.withColumn("rank", F.size(F.filter("used", lambda u: u)))
           .withColumn("rss", F.greatest(F.lit(0.0), F.col("swept")[k][k]))
           .withColumn("coef", F.transform("used", lambda u, i: F.when(u, F.col("swept")[i][k])))
           .withColumn("cov", F.transform("used", lambda u, i: F.transform("used", lambda w, j: F.when(
               u & w, -F.col("swept")[i][j]).otherwise(0.0))))
           .withColumn("df_resid", (F.col("n") - F.col("rank") - absorbed).cast("long")))
    s2 = F.when(F.col("df_resid") > 0, F.col("rss") / F.col("df_resid"))
    mean = F.slice("mean", 1, k)
    out = out.withColumn("s2", s2).withColumn("tq", t_quantile(0.975, F.col("df_resid")))
    lean = F.transform("coef", lambda c: F.coalesce(c, F.lit(0.0)))
    r2 = F.when(F.col("_tss") > 0, 1 - F.col("rss") / F.col("_tss"))
    out = (out.withColumn("intercept", F.col("mean")[k] - dot(lean, mean))
           .withColumn("se", F.transform("coef", lambda c, i: F.when(c.isNotNull(), F.sqrt(
               F.greatest(F.lit(0.0), F.col("s2") * F.col("cov")[i][i])))))
           .withColumn("se_intercept", F.sqrt(F.col("s2") * (1 / F.col("n") + dot(mean, F.transform(
               "cov", lambda row: dot(row, mean))))))
           .withColumn("r2", r2))
    free = F.col("rank") + absorbed - 1
    return (out.withColumn("adj_r2", F.when(F.col("df_resid") > 0, 1 - (1 - F.col("r2")) * (F.col("n") - 1)
                                            / F.col("df_resid")))
            .withColumn("f_statistic", F.when((F.col("rss") > 0) & (free > 0), (F.col("_tss") - F.col("rss")) / free
                                              / F.col("s2")))
            .withColumn("f_p_value", f_p_value(F.col("f_statistic"), free, F.col("df_resid"))).drop("_tss"))


def fit(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One model row (a group, if ``by``) of ``y`` on an intercept and ``xs``."""
    return solve(moments(df, y, xs, by), len(xs))


def summary(model: DataFrame, names: Sequence[str], intercept: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """A row a term: estimate, error, t, p, 95 % interval, whether it is aliased, and the fit's statistics."""
    def term(name, estimate, error):
        return F.struct(F.lit(name).alias("term"), estimate.alias("estimate"), error.alias("std_error"))

    rows = [term("(Intercept)", F.col("intercept"), F.col("se_intercept"))] if intercept else []
    rows += [term(nm, F.col("coef")[i], F.col("se")[i]) for i, nm in enumerate(names)]
    out = model.select(*by, F.explode(F.array(*rows)).alias("r"), "n", "tq", "df_resid", "adj_r2", "f_statistic",
                       "f_p_value")
    t = F.when(F.col("r.std_error") > 0, F.col("r.estimate") / F.col("r.std_error"))
    half = F.col("tq") * F.col("r.std_error")
    return out.select(*by, "r.term", "r.estimate", "r.std_error", t.alias("t_value"),
                      t_p_value(t, F.col("df_resid")).alias("p_value"), (F.col("r.estimate") - half).alias("lwr"),
                      (F.col("r.estimate") + half).alias("upr"), F.col("r.estimate").isNull().alias("aliased"),
                      F.col("n").cast("bigint").alias("nobs"), "adj_r2", "df_resid", "f_statistic", "f_p_value")


def leverage(xs: Sequence[Column]) -> Column:
    """d' S⁻¹ d of the used regressors, ``xs`` being centred."""
    d = F.array(*xs)
    return F.aggregate(F.transform("cov", lambda row, i: d[i] * F.aggregate(F.zip_with(row, d, lambda a, b: a * b),
                                                                          F.lit(0.0), lambda s, v: s + v)),
                       F.lit(0.0), lambda s, v: s + v)


def predict(df: DataFrame, model: DataFrame, xs: Sequence[str]) -> DataFrame:
    """``df`` with fit, lwr and upr of a one-row model; NULL where a regressor is."""
    keep = df.columns
    out = attach_scalars(df, model.select("n", "mean", "coef", "cov", "intercept", "s2", "tq"))
    part = F.col("intercept")
    for i, x in enumerate(xs):
        part = part + F.coalesce(F.col("coef")[i], F.lit(0.0)) * F.col(x)
    h = 1 / F.col("n") + leverage([F.col(x) - F.col("mean")[i] for i, x in enumerate(xs)])
    band = F.col("tq") * F.sqrt(F.col("s2") * h)
    return out.select(*keep, part.alias("fit"), (part - band).alias("lwr"), (part + band).alias("upr"))
