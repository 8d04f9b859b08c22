"""Panels and regressions against closed-form numpy fits on inline data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lintel.operators import ols, panel

Z = 1.959963985


def t975(df):
    return Z + (Z**3 + Z) / (4 * df) + (5 * Z**5 + 16 * Z**3 + 3 * Z) / (96 * df**2) + \
        (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / (384 * df**3)


def test_densify_fills_and_lags(spark):
    # key b misses 2021; 2022 is absent for everyone and stays absent.
    df = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 2.0), ("b", 2020, 5.0), ("a", 2023, 4.0)],
                               "k string, year int, v double")
    d = panel.densify(df, ["k"], "year", ["v"])
    d = panel.with_lags(d, ["k"], "year", ["v"])
    got = {(r.k, r.year): (r.v, r.v_t1) for r in d.collect()}
    assert got[("b", 2021)] == (0.0, 5.0)
    assert got[("b", 2020)] == (5.0, None)
    assert got[("a", 2023)] == (4.0, 2.0)
    assert ("a", 2022) not in got and len(got) == 6
    full = panel.densify(df, ["k"], "year", ["v"], full_range=True)
    assert full.count() == 8


def test_expand_grid_full_product(spark):
    df = spark.createDataFrame([("a", "s1", 1, 1.0), ("b", "s2", 2, 1.0)], "r string, s string, year int, v double")
    assert panel.expand_grid(df, ["r", "s"], "year", ["v"]).count() == 8


def test_grouped_simple_guards(spark):
    rows = []
    rows += [("exact", float(x), 2 + 3 * float(x)) for x in range(5)]
    rows += [("one", 1.0, 7.0)]
    rows += [("two", 1.0, 1.0), ("two", 2.0, 3.0)]
    rows += [("flat", 2.0, 1.0), ("flat", 2.0, 2.0), ("flat", 2.0, 6.0)]
    rows += [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = {r.g: r for r in ols.grouped_simple(df, "g", "y", "x").collect()}
    assert "none" not in out
    assert out["exact"].beta == pytest.approx(3.0) and out["exact"].alpha == pytest.approx(2.0)
    assert out["exact"].adj_r2 == pytest.approx(1.0)
    assert out["one"].beta is None and out["one"].alpha == 7.0 and out["one"].adj_r2 == 0.0
    assert out["two"].adj_r2 is None and out["two"].beta == pytest.approx(2.0)
    assert out["flat"].beta is None and out["flat"].alpha == pytest.approx(3.0)
    missing = [r.g for r in ols.groups_without_pairs(df, "g", "y", "x").collect()]
    assert missing == ["none"]


def _random_panel(n=80, k=3, seed=1):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, k))
    y = 1.5 + X @ np.array([0.5, -2.0, 0.25]) + rng.normal(scale=0.3, size=n)
    return X, y


def test_panel_ols_matches_numpy(spark):
    X, y = _random_panel()
    pdf = pd.DataFrame({"y": y, "x0": X[:, 0], "x1": X[:, 1], "x2": X[:, 2]})
    df = spark.createDataFrame(pdf)
    xs = ["x0", "x1", "x2"]
    model = ols.fit(df, "y", xs)
    m = model.first()
    A = np.column_stack([np.ones(len(y)), X])
    beta, *_ = np.linalg.lstsq(A, y, rcond=None)
    resid = y - A @ beta
    dof = len(y) - A.shape[1]
    s2 = resid @ resid / dof
    cov = s2 * np.linalg.inv(A.T @ A)
    assert m.b_c == pytest.approx(beta[0], rel=1e-9)
    assert [m.b_0, m.b_1, m.b_2] == pytest.approx(list(beta[1:]), rel=1e-9)
    assert [m.se_c, m.se_0, m.se_1, m.se_2] == pytest.approx(list(np.sqrt(np.diag(cov))), rel=1e-8)
    r2 = 1 - resid @ resid / ((y - y.mean()) @ (y - y.mean()))
    assert m.adj_r2 == pytest.approx(1 - (1 - r2) * (len(y) - 1) / dof, rel=1e-9)
    pred = ols.predict(df, model, xs).toPandas()
    h = np.einsum("ij,jk,ik->i", A, np.linalg.inv(A.T @ A), A)
    band = t975(dof) * np.sqrt(s2 * h)
    assert np.allclose(pred["fit"], A @ beta, rtol=1e-9)
    assert np.allclose(pred["upr"] - pred["fit"], band, rtol=1e-7)


def test_t_series_close_to_table():
    # t(0.975, 30) = 2.042272456, t(0.975, 100) = 1.983971519
    assert t975(30) == pytest.approx(2.042272456, abs=3e-6)
    assert t975(100) == pytest.approx(1.983971519, abs=1e-7)


def test_fixed_effects_match_dummy_regression(spark):
    rng = np.random.default_rng(7)
    n_i, n_s, n_t = 6, 3, 8
    rows = []
    for i in range(n_i):
        for s in range(n_s):
            for t in range(n_t):
                x = rng.normal(size=2)
                y = 2 * x[0] - x[1] + 0.3 * t + i * 0.7 - s * 0.4 + rng.normal(scale=0.2)
                rows.append((f"r{i}", f"s{s}", 2000 + t, float(x[0]), float(x[1]), float(2000 + t), float(y)))
    pdf = pd.DataFrame(rows, columns=["r", "s", "year", "x0", "x1", "yr", "y"])
    df = spark.createDataFrame(pdf)
    train = df.filter(F.col("year") < 2007)
    cols = ["y", "x0", "x1", "yr"]
    tdm = ols.fe_demean(train, train, "r", "s", cols)
    model = ols.fe_fit(tdm, "y", ["x0", "x1", "yr"], "r", "s", "year")
    m = model.first()
    assert m.balanced
    rows_dm = ols.fe_demean(train, df.filter(F.col("year") == 2007), "r", "s", cols)
    pred = ols.fe_predict(rows_dm, model, "y", ["x0", "x1", "yr"]).toPandas().sort_values(["r", "s"])

    tr = pdf[pdf.year < 2007]
    te = pdf[pdf.year == 2007].sort_values(["r", "s"])

    def design(d):
        cols_ = [np.ones(len(d)), d.x0, d.x1, d.yr]
        cols_ += [(d.r == f"r{i}").astype(float) for i in range(1, n_i)]
        cols_ += [(d.s == f"s{s}").astype(float) for s in range(1, n_s)]
        return np.column_stack(cols_)

    A, B = design(tr), design(te)
    beta, *_ = np.linalg.lstsq(A, tr.y.values, rcond=None)
    dof = len(tr) - A.shape[1]
    resid = tr.y.values - A @ beta
    s2 = resid @ resid / dof
    assert int(m.df_resid) == dof
    assert [m.b_0, m.b_1, m.b_2] == pytest.approx(list(beta[1:4]), rel=1e-7)
    inv = np.linalg.pinv(A.T @ A)
    h = np.einsum("ij,jk,ik->i", B, inv, B)
    assert np.allclose(pred["fit"].values, B @ beta, rtol=1e-7)
    assert np.allclose((pred["upr"] - pred["fit"]).values, t975(dof) * np.sqrt(s2 * h), rtol=1e-6)


def test_densify_has_no_limit_on_periods(spark):
    df = spark.range(10_500).selectExpr("'a' AS k", "id AS year", "1.0D AS v").union(
        spark.createDataFrame([("b", 3, 2.0)], "k string, year long, v double"))
    d = panel.densify(df, ["k"], "year", ["v"])
    assert d.count() == 21_000
    assert d.where("k = 'b'").agg({"v": "sum"}).first()[0] == 2.0


def test_t_quantile_below_thirty(spark):
    known = {1: 12.706204736, 2: 4.302652730, 5: 2.570581836, 10: 2.228138852, 29: 2.045229642}
    df = spark.createDataFrame([(k,) for k in [0, *known]], "n int")
    got = {r.n: r.t for r in df.selectExpr("n", f"{ols.t_quantile('n')} AS t").collect()}
    assert got.pop(0) is None
    assert got == pytest.approx(known, abs=1e-8)


def test_fit_of_one_regressor(spark):
    x = np.arange(8.0)
    y = 3 + 2 * x + np.array([0.1, -0.1, 0.2, 0.0, -0.2, 0.1, 0.0, -0.1])
    m = ols.fit(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "y", ["x"]).first()
    slope = np.polyfit(x, y, 1)[0]
    assert m.b_0 == pytest.approx(slope, rel=1e-9)
