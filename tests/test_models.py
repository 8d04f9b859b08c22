"""Quantiles, rolling cutoffs and unbalanced panels against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.operators import quantiles, rolling, sweep, two_way

PS = [0.0, 0.1, 0.25, 0.5, 0.8, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["spread", "ties", "heavy"])
def test_exact_quantiles(spark, kind):
    rnd = np.random.default_rng(1)
    v = {"spread": rnd.normal(size=20_000), "ties": rnd.integers(0, 4, 20_000).astype(float),
         "heavy": np.exp(rnd.normal(size=20_000) * 20)}[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 7, "v double").repartition(7)
    got = {r["p"]: r["value"] for r in quantiles.exact_quantiles(df, "v", PS, limit=50).collect()}
    for p in PS:
        assert np.isclose(got[p], np.quantile(v, p), rtol=1e-12), (kind, p)


def test_exact_quantiles_odd_cases(spark):
    none = quantiles.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]).collect()
    assert [(r["p"], r["value"]) for r in none] == [(0.5, None)]
    one = quantiles.exact_quantiles(spark.createDataFrame([(3,)], "v int"), "v", [0.0, 0.3, 1.0]).collect()
    assert {r["value"] for r in one} == {3.0}


def _panel(missing):
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(12):
        for s in range(5):
            for t in range(6):
                x, z = rnd.normal() + i * 0.3, rnd.normal() + t
                y = 2 * x - z + i + 3 * s + rnd.normal()
                if not missing or rnd.random() > 1 / 3:
                    rows.append((f"r{i:02d}", f"s{s}", 2000 + t, float(x), float(z), float(y)))
    return rows


SCHEMA = "r string, s string, year int, x double, z double, y double"


def _dummies(rows, r, s):
    return np.array([[float(a[0] == k) for k in r] + [float(a[1] == k) for k in s] for a in rows])


def test_unbalanced_panel_equals_dummy_fit(spark):
    rows = _panel(True)
    rows += [(f"q{i}", f"u{j}", 2000 + t, float(i * t), float(j + t * t), float(i + 2 * j + t % 3))   # a part of its own
             for i in range(3) for j in range(2) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    fit = two_way.Fit(df, "y", ["x", "z"], "r", "s")
    r, s = sorted({a[0] for a in rows}), sorted({a[1] for a in rows})
    X = np.column_stack([[a[3] for a in rows], [a[4] for a in rows], _dummies(rows, r, s)])
    y = np.array([a[5] for a in rows])
    inv = np.linalg.pinv(X.T @ X)
    beta = inv @ X.T @ y
    rank = np.linalg.matrix_rank(X)
    rss = float(((y - X @ beta) ** 2).sum())
    s2 = rss / (len(y) - rank)
    got = {g["term"]: g for g in fit.summary(["x", "z"]).collect()}
    assert rank == 2 + len(r) + len(s) - 2 and fit.absorbed == rank - 2
    for i, name in enumerate(["x", "z"]):
        assert np.isclose(got[name]["estimate"], beta[i], rtol=1e-7)
        assert np.isclose(got[name]["std_error"], np.sqrt(s2 * inv[i, i]), rtol=1e-7)
        assert got[name]["df_resid"] == len(y) - rank
    # predictions of all rows, and of pairs without a cell, across parts and unseen
    extra = [("r00", "s1", 1999, 0.5, 1.5, None), ("r00", "u0", 1999, 0.5, 1.5, None), ("new", "s0", 1, 0.0, 0.0, None)]
    pred = fit.predict(spark.createDataFrame(rows + extra, SCHEMA)).toPandas().set_index(["r", "s", "year"])
    tq = sweep.solve(sweep.moments(df, "y", ["x"]), 1, absorbed=len(y) - 1 - (len(y) - rank)).first()["tq"]
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    want = X @ beta
    for a, f, e in zip(rows, want, tq * np.sqrt(s2 * h)):
        p = pred.loc[a[:3]]
        assert np.isclose(p["fit"], f, atol=1e-6) and np.isclose(p["upr"] - p["fit"], e, rtol=1e-6)
    v = np.concatenate([[0.5, 1.5], _dummies([("r00", "s1")], r, s)[0]])
    p = pred.loc[("r00", "s1", 1999)]
    assert np.isclose(p["fit"], v @ beta, atol=1e-6) and np.isclose(p["fit"] - p["lwr"], tq * np.sqrt(s2 * v @ inv @ v))
    assert pred.loc[("r00", "u0", 1999)].isna()["fit"] and pred.loc[("new", "s0", 1)].isna()["fit"]


def test_rolling_cutoffs(spark):
    rows = _panel(False)
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {r["year"]: r for r in rolling.validate(df, "y", ["x", "z"], "year", "x").collect()}
    fixed = {r["year"]: r for r in rolling.validate_two_way(df, "y", ["x", "z"], "r", "s", "year", "x").collect()}
    a = np.array([x[2:] for x in rows], float)
    r, s = sorted({x[0] for x in rows}), sorted({x[1] for x in rows})
    d = _dummies(rows, r, s)
    assert sorted(plain) == sorted(fixed) == [2001, 2002, 2003, 2004, 2005]
    for c in range(2001, 2006):
        tr, te = a[:, 0] < c, a[:, 0] == c
        for got, X in ((plain[c], np.column_stack([np.ones(len(a)), a[:, 1:3]])), (fixed[c], np.column_stack([a[:, 1:3], d]))):
            beta = np.linalg.lstsq(X[tr], a[tr, 3], rcond=None)[0]
            assert np.isclose(got["rmse_fit"], np.sqrt(np.mean((a[te, 3] - X[te] @ beta) ** 2)), rtol=1e-8)
            assert np.isclose(got["rmse_raw"], np.sqrt(np.mean((a[te, 3] - a[te, 1]) ** 2)))
            assert got["n_train"] == tr.sum() and got["n_test"] == te.sum()
        assert fixed[c]["balanced"]
    some = rolling.validate_two_way(df.where(F.col("x") > -0.5), "y", ["x"], "r", "s", "year", "x").collect()
    assert not all(x["balanced"] for x in some)
