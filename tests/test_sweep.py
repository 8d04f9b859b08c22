"""Rank-revealing fits and tail probabilities against numpy and fixed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.functions import tails
from lintel.operators import sweep


def _tail(t, df):
    """Two-sided t tail by Gauss-Legendre quadrature of the density, in the angle atan(t / sqrt(df))."""
    x, w = np.polynomial.legendre.leggauss(200)
    a, b = math.atan(t / math.sqrt(df)), math.pi / 2
    u = (b - a) / 2 * x + (a + b) / 2
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 2 * c * (b - a) / 2 * float(w @ np.cos(u) ** (df - 1))


def test_t_tail_and_quantile(spark):
    cases = [(t, d) for d in (1, 2, 3, 5, 10, 29, 30, 100, 1000) for t in (0.0, 0.1, 1.0, 2.0, 4.5)]
    df = spark.createDataFrame(cases, "t double, df int")
    for r in df.select("t", "df", tails.t_p_value(F.col("t"), F.col("df")).alias("p")).collect():
        assert abs(r["p"] - _tail(r["t"], r["df"])) < 1e-10, r
    # fixed values: t(0.975)
    known = {1: 12.706204736, 2: 4.302652730, 3: 3.182446305, 4: 2.776445105, 10: 2.228138852, 29: 2.045229642,
             120: 1.979930405}
    q = spark.createDataFrame([(k,) for k in known], "df int").select("df", tails.t_quantile(0.975, F.col("df")).alias("q"))
    for r in q.collect():
        assert abs(r["q"] - known[r["df"]]) < 1e-9
    assert spark.range(1).select(tails.t_quantile(0.975, F.lit(0))).first()[0] is None


def test_f_tail(spark):
    # F(1, d) is t squared; for df1 = 2 the tail is (1 + 2 f / d) ** (-d / 2)
    df = spark.createDataFrame([(0.5, 7), (3.0, 12), (25.0, 40)], "f double, d int")
    for r in df.select("f", "d", tails.f_p_value(F.col("f"), 1, F.col("d")).alias("one"),
                       tails.f_p_value(F.col("f"), 2, F.col("d")).alias("two")).collect():
        assert abs(r["one"] - _tail(math.sqrt(r["f"]), r["d"])) < 1e-10
        assert abs(r["two"] - (1 + 2 * r["f"] / r["d"]) ** (-r["d"] / 2)) < 1e-10


@pytest.fixture(scope="module")
def wide(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 8)) * [1, 10, 0.1, 5, 1, 1, 1000, 1] + [0, 50, 0, 0, 3, 0, 1e4, 0]
    x[:, 4] = x[:, 0] + x[:, 2]                          # a sum of two others
    y = x @ [1, -2, 3, 0.5, 0, 4, 0.01, 0] + 7 + rnd.normal(size=300)
    names = [f"x{i}" for i in range(8)]
    return x, y, names, spark.createDataFrame([[float(v) for v in (*a, b)] for a, b in zip(x, y)], [*names, "y"])


def test_aliased_regressor_is_named(spark, wide):
    x, y, names, df = wide
    model = sweep.fit(df, "y", names)
    rows = {r["term"]: r for r in sweep.summary(model, names).collect()}
    keep = [i for i in range(8) if i != 4]
    a = np.column_stack([np.ones(300), x[:, keep]])
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rss = float(((y - a @ beta) ** 2).sum())
    s2 = rss / (300 - 8)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(a.T @ a)))
    assert [t for t, r in rows.items() if r["aliased"]] == ["x4"]
    for t, b, e in zip(["(Intercept)", *[names[i] for i in keep]], beta, se):
        r = rows[t]
        assert np.isclose(r["estimate"], b, rtol=1e-8) and np.isclose(r["std_error"], e, rtol=1e-8)
        assert abs(r["p_value"] - _tail(abs(b / e), 292)) < 1e-8 and r["df_resid"] == 292
        assert np.isclose(r["upr"] - r["lwr"], 2 * 1.968121 * e, rtol=1e-5)
    tss = float(((y - y.mean()) ** 2).sum())
    assert np.isclose(rows["x0"]["f_statistic"], (tss - rss) / 7 / s2, rtol=1e-8)
    got = sweep.predict(df, model, names).select("fit", "lwr", "upr").toPandas()
    fit = a @ beta
    h = np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a)
    assert np.allclose(got["fit"], fit) and np.allclose(got["upr"] - got["fit"], 1.9681213 * np.sqrt(s2 * h), rtol=1e-6)


def test_fit_by_group_and_odd_cases(spark, wide):
    x, y, names, df = wide
    g = df.withColumn("g", (F.col("x0") > 0).cast("int"))
    for r in sweep.fit(g, "y", names[:2], by=["g"]).collect():
        m = (x[:, 0] > 0) == bool(r["g"])
        a = np.column_stack([np.ones(m.sum()), x[m, :2]])
        assert np.allclose([r["intercept"], *r["coef"]], np.linalg.lstsq(a, y[m], rcond=None)[0])
    flat = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, 1.0), (1.0, 4.0, 1.0)], "a double, b double, c double")
    r = sweep.fit(flat, "b", ["a"]).first()              # a constant regressor
    assert r["coef"] == [None] and r["intercept"] == 3.0 and r["df_resid"] == 2
    assert sweep.fit(flat, "b", ["a", "c"]).first()["n"] == 2
    assert sweep.fit(flat.limit(0), "b", ["a"], by=["c"]).count() == 0
