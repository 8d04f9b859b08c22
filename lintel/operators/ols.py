"""Least squares as aggregates (M-series).

A fit never leaves Spark as rows: one aggregate reduces the training rows to
a handful of moments (n, means, centred cross-products), the normal
equations are solved in closed form as column expressions on that one-row
frame, and the solution is attached to the rows to predict.

The closed-form expressions are generated once as SQL text
(:func:`fit_steps`, :func:`predict_exprs`) and used by Spark through
``F.expr``; the same text is valid DuckDB SQL, which the oracle uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators.joins import attach_scalars

# Two-sided 95 % normal quantile.
Z975 = 1.959963985
# The t-quantile series below is accurate to ~2e-6 from 30 degrees of freedom.
MIN_T_DF = 30
# t(0.975) for 1 to 29 degrees of freedom.
T975 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851,
    2.364624252, 2.306004135, 2.262157163, 2.228138852, 2.200985160, 2.178812830,
    2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.100922040,
    2.093024054, 2.085963447, 2.079613845, 2.073873068, 2.068657610, 2.063898562,
    2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642,
)


def div(a: str, b: str) -> str:
    """``a / b`` that is NULL (not an error) when ``b`` is 0."""
    return f"(({a}) / nullif({b}, 0))"


def nonneg_sqrt(a: str) -> str:
    return f"sqrt(CASE WHEN ({a}) < 0 THEN 0 ELSE ({a}) END)"


def t_quantile(df: str) -> str:
    """t(0.975, ν) from the Cornish-Fisher series in the normal quantile,
    and from the table below 30, where the series is not accurate enough;
    NULL for ν < 1."""
    z = f"{Z975}"
    v = f"CAST({df} AS DOUBLE)"
    z3, z5, z7 = f"power({z}, 3)", f"power({z}, 5)", f"power({z}, 7)"
    series = (f"{z} + ({z3} + {z}) / (4 * {v})"
              f" + (5 * {z5} + 16 * {z3} + 3 * {z}) / (96 * {v} * {v})"
              f" + (3 * {z7} + 19 * {z5} + 17 * {z3} - 15 * {z}) / (384 * {v} * {v} * {v})")
    table = " ".join(f"WHEN {df} = {n} THEN CAST({t} AS DOUBLE)" for n, t in enumerate(T975, 1))
    return f"CASE WHEN {df} >= {MIN_T_DF} THEN {series} {table} END"


# ------------------------------------------------------- symbolic linear algebra

def _det(m: list[list[str]]) -> str:
    k = len(m)
    if k == 0:
        return "1"
    if k == 1:
        return m[0][0]
    if k == 2:
        return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
    terms = []
    for j in range(k):
        minor = [row[:j] + row[j + 1:] for row in m[1:]]
        sign = "+" if j % 2 == 0 else "-"
        terms.append(f"{sign} {m[0][j]} * {_det(minor)}")
    return "(" + " ".join(terms).lstrip("+ ") + ")"


def _sym(i: int, j: int, name: str = "s") -> str:
    a, b = min(i, j), max(i, j)
    return f"{name}_{a}{b}"


def inverse_steps(k: int) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Expressions for the inverse of the symmetric matrix ``s_ij`` (i ≤ j):
    first the determinant, then ``inv_ij = cofactor_ji / det``."""
    m = [[_sym(i, j) for j in range(k)] for i in range(k)]
    det = [("det", _det(m))]
    inv = []
    for i in range(k):
        for j in range(i, k):
            minor = [row[:i] + row[i + 1:] for r, row in enumerate(m) if r != j]
            sign = "" if (i + j) % 2 == 0 else "-"
            inv.append((f"inv_{i}{j}", div(f"{sign}{_det(minor)}", "det")))
    return det, inv


def fit_steps(k: int, n_absorbed: str = "0", tss: str = "s_yy") -> list[list[tuple[str, str]]]:
    """Successive column steps turning moments into a fitted model.

    Input columns: ``n``, ``m_y``, ``m_i`` (means), ``s_ij`` (centred
    cross-products of the regressors), ``s_iy``, ``s_yy``.  ``n_absorbed`` is
    the number of extra parameters absorbed before the fit (fixed effects);
    ``tss`` the total sum of squares for R² (the raw, not the demeaned, one
    when effects were absorbed).
    """
    det, inv = inverse_steps(k)
    steps: list[list[tuple[str, str]]] = [det, inv]
    betas = []
    for i in range(k):
        terms = " + ".join(f"inv_{min(i, j)}{max(i, j)} * s_{j}y" for j in range(k))
        betas.append((f"b_{i}", f"({terms})"))
    steps.append(betas)
    intercept = "m_y - (" + " + ".join(f"b_{i} * m_{i}" for i in range(k)) + ")"
    rss = "s_yy - (" + " + ".join(f"b_{i} * s_{i}y" for i in range(k)) + ")"
    steps.append([("b_c", intercept), ("rss", rss),
                  ("df_resid", f"(n - {k} - 1 - ({n_absorbed}))")])
    steps.append([("s2", div("rss", "df_resid")),
                  ("r2", f"1 - {div('rss', tss)}")])
    quad = " + ".join(f"m_{i} * inv_{min(i, j)}{max(i, j)} * m_{j}" for i in range(k) for j in range(k))
    se = [(f"se_{i}", nonneg_sqrt(f"s2 * inv_{i}{i}")) for i in range(k)]
    se.append(("se_c", nonneg_sqrt(f"s2 * ({div('1', 'n')} + {quad})")))
    se.append(("adj_r2", f"1 - (1 - r2) * {div('n - 1', 'df_resid')}"))
    se.append(("tq", t_quantile("df_resid")))
    steps.append(se)
    return steps


def moments(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """One aggregate: n, means and centred (co)variance sums.  Rows with any
    NULL among ``y``/``xs`` must be filtered by the caller."""
    k = len(xs)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("m_y")]
    aggs += [F.avg(x).alias(f"m_{i}") for i, x in enumerate(xs)]
    for i in range(k):
        for j in range(i, k):
            aggs.append((F.covar_pop(xs[i], xs[j]) * F.count(F.lit(1))).alias(f"s_{i}{j}"))
        aggs.append((F.covar_pop(xs[i], y) * F.count(F.lit(1))).alias(f"s_{i}y"))
    aggs.append((F.var_pop(y) * F.count(F.lit(1))).alias("s_yy"))
    return df.agg(*aggs)


def apply_steps(df: DataFrame, steps: list[list[tuple[str, str]]]) -> DataFrame:
    for step in steps:
        df = df.select("*", *[F.expr(e).alias(n) for n, e in step])
    return df


def fit(df: DataFrame, y: str, xs: Sequence[str], n_absorbed: str = "0") -> DataFrame:  # noqa: D401
    """M2: one-row model frame (coefficients, errors, fit statistics)."""
    complete = df
    for c in [y, *xs]:
        complete = complete.filter(F.col(c).isNotNull())
    return apply_steps(moments(complete, y, xs), fit_steps(len(xs), n_absorbed))


def predict_exprs(xs: Sequence[str], extra_h: str = "0") -> list[list[tuple[str, str]]]:
    """M4: fit and 95 % confidence band for rows carrying the model columns.

    ``h = 1/n + d'S⁻¹d`` with ``d`` the centred regressors; ``extra_h`` adds
    the leverage of absorbed fixed effects (then the ``1/n`` term is part of
    it and the caller passes centred regressors in ``xs``)."""
    k = len(xs)
    d = [f"({xs[i]} - m_{i})" for i in range(k)]
    quad = " + ".join(f"{d[i]} * inv_{min(i, j)}{max(i, j)} * {d[j]}" for i in range(k) for j in range(k))
    lin = " + ".join(f"b_{i} * {xs[i]}" for i in range(k))
    base_h = div("1", "n") if extra_h == "0" else f"({extra_h})"
    return [[("fit", f"b_c + {lin}"), ("h", f"{base_h} + {quad}")],
            [("band", f"tq * {nonneg_sqrt('s2 * h')}")],
            [("lwr", "fit - band"), ("upr", "fit + band")]]


def predict(df: DataFrame, model: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Attach the one-row model and compute ``fit``, ``lwr``, ``upr``."""
    keep = df.columns
    out = apply_steps(attach_scalars(df, model), predict_exprs(xs))
    return out.select(*keep, "fit", "lwr", "upr")


def summary(model: DataFrame, names: Sequence[str], intercept: bool = True) -> DataFrame:
    """M6: one row per term (estimate, std error, t) with nobs and adj R²."""
    terms = ([("(Intercept)", "b_c", "se_c")] if intercept else []) + \
        [(nm, f"b_{i}", f"se_{i}") for i, nm in enumerate(names)]
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(b).alias("estimate"), F.col(s).alias("std_error"))
                     for t, b, s in terms])
    out = model.select(F.explode(rows).alias("r"), "n", "adj_r2", "df_resid")
    return out.select("r.term", "r.estimate", "r.std_error",
                      F.expr("r.estimate / nullif(r.std_error, 0)").alias("t_value"),
                      F.col("n").cast("bigint").alias("nobs"), "adj_r2",
                      F.col("df_resid").cast("bigint").alias("df_resid"))


# ------------------------------------------------------------ grouped simple OLS

def grouped_simple(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """M1: per group ``y = alpha + beta x`` over complete pairs.

    Guards: groups without a complete pair are absent (see
    :func:`groups_without_pairs`); with one pair or constant ``x`` the slope
    is NULL, alpha is the mean of ``y`` and adj R² is 0; with two pairs adj R²
    is undefined (NULL)."""
    c = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = c.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(x).alias("mx"),
                             F.var_pop(x).alias("vx"), F.covar_pop(x, y).alias("cxy"),
                             F.regr_r2(F.col(y), F.col(x)).alias("r2"))
    flat = (F.col("n") < 2) | (F.col("vx") == 0)
    beta = F.when(flat, F.lit(None).cast("double")).otherwise(F.col("cxy") / F.col("vx"))
    alpha = F.when(flat, F.col("my")).otherwise(F.col("my") - beta * F.col("mx"))
    adj = (F.when(flat, F.lit(0.0))
           .when(F.col("n") <= 2, F.lit(None).cast("double"))
           .otherwise(1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2)))
    return g.select(group, alpha.alias("alpha"), beta.alias("beta"), adj.alias("adj_r2"),
                    F.col("n").cast("bigint").alias("n"))


def groups_without_pairs(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """Q4: groups that have rows but no complete ``(x, y)`` pair."""
    has = (F.col(x).isNotNull() & F.col(y).isNotNull()).cast("int")
    return df.groupBy(group).agg(F.max(has).alias("_has")).filter(F.col("_has") == 0).select(group)


# ------------------------------------------------------ two-way fixed effects

def fe_demean(train: DataFrame, rows: DataFrame, g1: str, g2: str, cols: Sequence[str]) -> DataFrame:
    """M3 helper: ``x − x̄_g1 − x̄_g2 + x̄`` for ``cols`` on ``rows``, with the
    means taken over ``train`` (exact two-way demeaning on a balanced panel).

    The per-group means are dimension-sized (one row per group) and are
    joined back by key; the overall means are one row."""
    from lintel.operators.joins import small
    m1 = small(train.groupBy(g1).agg(*[F.avg(c).alias(f"_a_{c}") for c in cols]))
    m2 = small(train.groupBy(g2).agg(*[F.avg(c).alias(f"_b_{c}") for c in cols]))
    m0 = train.agg(*[F.avg(c).alias(f"_o_{c}") for c in cols])
    out = attach_scalars(rows.join(m1, g1, "left").join(m2, g2, "left"), m0)
    for c in cols:
        out = out.withColumn(f"{c}_dm", F.col(c) - F.col(f"_a_{c}") - F.col(f"_b_{c}") + F.col(f"_o_{c}"))
        out = out.withColumn(f"{c}_off", F.col(f"_a_{c}") + F.col(f"_b_{c}") - F.col(f"_o_{c}"))
    drop = [f"_{p}_{c}" for p in "abo" for c in cols]
    return out.drop(*drop)


def fe_fit(train_dm: DataFrame, y: str, xs: Sequence[str], g1: str, g2: str, t: str) -> DataFrame:
    """M3: OLS of demeaned ``y`` on demeaned ``xs`` with the two absorbed
    effects counted in the degrees of freedom; R² against the raw ``y``.
    Adds ``n_g1``, ``n_g2``, ``n_t`` and ``balanced`` to the model row."""
    k = len(xs)
    ydm, xdm = f"{y}_dm", [f"{x}_dm" for x in xs]
    mom = moments(train_dm, ydm, xdm)
    extra = train_dm.agg(F.countDistinct(g1).alias("n_g1"), F.countDistinct(g2).alias("n_g2"),
                         F.countDistinct(t).alias("n_t"),
                         (F.var_pop(y) * F.count(F.lit(1))).alias("s_yy_raw"))
    mom = attach_scalars(mom, extra).withColumn(
        "balanced", F.col("n") == F.col("n_g1") * F.col("n_g2") * F.col("n_t"))
    return apply_steps(mom, fit_steps(k, n_absorbed="n_g1 + n_g2 - 2", tss="s_yy_raw"))


FE_LEVERAGE = "1 / (n_g2 * n_t) + 1 / (n_g1 * n_t) - 1 / (n_g1 * n_g2 * n_t)"


def fe_predict(rows_dm: DataFrame, model: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """M4 under fixed effects: ``fit = ȳ_g1 + ȳ_g2 − ȳ + b'x̃`` with the
    balanced-panel leverage of the absorbed effects added to ``h``."""
    keep = rows_dm.columns
    xdm = [f"{x}_dm" for x in xs]
    steps = predict_exprs(xdm, extra_h=FE_LEVERAGE)
    out = apply_steps(attach_scalars(rows_dm, model), steps)
    off = F.col(f"{y}_off")
    return out.select(*keep, (F.col("fit") + off).alias("fit"), (F.col("lwr") + off).alias("lwr"),
                      (F.col("upr") + off).alias("upr"))
