"""Steps 4-5: dense panels, lags, grouped and panel regressions, nowcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators import ols, panel, rollups
from lintel.operators.joins import attach_scalars
from lintel.plans.common import (B_CHAIN_SQL, LAST_ACTUAL_YEAR, NOWCAST_YEAR, SQL_A_AGG, SQL_FACT_A_CLEAN,
                                 SQL_MERGED, merged_panel, r4, tables)
from lintel.plans.oracle_views import with_views
from lintel.plans.registry import register
from lintel.sources.tables import Tables

CRS, IATI = "usd_disbursement_crs", "usd_disbursement_iati"
XS = [IATI, f"{CRS}_t1", "delta_iati"]

_MERGED = with_views("fact_a", "fact_b", "publisher_map", "region_mapping", "iso_table",
                     extra=[SQL_FACT_A_CLEAN] + B_CHAIN_SQL + [SQL_A_AGG, SQL_MERGED])


def _cte_chain(base: str, steps, prefix: str) -> tuple[list[str], str]:
    """SQL CTEs applying ``steps`` (lists of (name, expr)) one after another."""
    ctes, prev = [], base
    for i, step in enumerate(steps):
        name = f"{prefix}{i}"
        cols = ", ".join(f"{e} AS {n}" for n, e in step)
        ctes.append(f"{name} AS (SELECT *, {cols} FROM {prev})")
        prev = name
    return ctes, prev


def _r6(c: str) -> F.Column:
    return F.round(F.col(c), 6)


# ----------------------------------------------------------------- the panel

def keyword_panel(t: Tables, materialize: bool = False) -> DataFrame:
    """Recipient × year panel of A and B, densified, with lags and ΔB.

    The panel is dimension-sized (recipients × years).  A model reads it
    several times (moments, then the rows to predict), so ``materialize``
    writes it once as an intermediate table in the shared folder instead of
    recomputing it for every read."""
    if materialize:
        from lintel.sources.warehouse import materialized
        return materialized(t, "keyword_panel", lambda tt: keyword_panel(tt, materialize=False))
    return lagged_panel(merged_panel(t))


def lagged_panel(merged: DataFrame) -> DataFrame:
    """The dense, lagged recipient × year panel of a reconciled table."""
    p0 = rollups.sum_by(merged, ["year", "recipient_iso3_code"], {CRS: CRS, IATI: IATI})
    d = panel.densify(p0, ["recipient_iso3_code"], "year", [CRS, IATI])
    d = panel.with_lags(d, ["recipient_iso3_code"], "year", [CRS, IATI])
    return panel.with_difference(d, IATI, f"{IATI}_t1", "delta_iati")


SQL_PANEL = f"""p0 AS (
  SELECT year, recipient_iso3_code, coalesce(sum({CRS}), 0) AS {CRS}, coalesce(sum({IATI}), 0) AS {IATI}
  FROM merged GROUP BY ALL
),
grid AS (SELECT k.recipient_iso3_code, y.year
         FROM (SELECT DISTINCT recipient_iso3_code FROM p0) k, (SELECT DISTINCT year FROM p0) y),
dense AS (
  SELECT g.recipient_iso3_code, g.year, coalesce(p.{CRS}, 0) AS {CRS}, coalesce(p.{IATI}, 0) AS {IATI}
  FROM grid g LEFT JOIN p0 p ON g.recipient_iso3_code = p.recipient_iso3_code AND g.year = p.year
),
kpanel AS (
  SELECT *, lag({CRS}) OVER w AS {CRS}_t1, lag({IATI}) OVER w AS {IATI}_t1,
         {IATI} - lag({IATI}) OVER w AS delta_iati
  FROM dense WINDOW w AS (PARTITION BY recipient_iso3_code ORDER BY year)
)"""

W_PANEL = _MERGED.rstrip() + ",\n" + SQL_PANEL


@register("dense_panel", ("A4", "J8", "P24"), W_PANEL + f"""
SELECT recipient_iso3_code, year, round({CRS}, 4) AS {CRS}, round({IATI}, 4) AS {IATI} FROM dense""")
def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merged_panel(tables(spark, sf_dir))
    p0 = rollups.sum_by(m, ["year", "recipient_iso3_code"], {CRS: CRS, IATI: IATI})
    d = panel.densify(p0, ["recipient_iso3_code"], "year", [CRS, IATI])
    return d.select("recipient_iso3_code", "year", r4(CRS).alias(CRS), r4(IATI).alias(IATI))


@register("panel_lags", ("O3", "W1", "W2"), W_PANEL + f"""
SELECT recipient_iso3_code, year, round({CRS}, 4) AS {CRS}, round({IATI}, 4) AS {IATI},
       round({CRS}_t1, 4) AS {CRS}_t1, round({IATI}_t1, 4) AS {IATI}_t1, round(delta_iati, 4) AS delta_iati
FROM kpanel""")
def panel_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = keyword_panel(tables(spark, sf_dir))
    return p.select("recipient_iso3_code", "year",
                    *[r4(c).alias(c) for c in [CRS, IATI, f"{CRS}_t1", f"{IATI}_t1", "delta_iati"]])


# ------------------------------------------------------------ grouped simple fit

@register("donor_fit", ("M1", "Q4"), _MERGED + f"""
SELECT donor_name,
       round(CASE WHEN count(*) < 2 OR var_pop({IATI}) = 0 THEN avg({CRS})
             ELSE avg({CRS}) - covar_pop({IATI}, {CRS}) / var_pop({IATI}) * avg({IATI}) END, 6) AS alpha,
       round(CASE WHEN count(*) < 2 OR var_pop({IATI}) = 0 THEN NULL
             ELSE covar_pop({IATI}, {CRS}) / var_pop({IATI}) END, 6) AS beta,
       round(CASE WHEN count(*) < 2 OR var_pop({IATI}) = 0 THEN 0
                  WHEN count(*) <= 2 THEN NULL
             ELSE 1 - (1 - regr_r2({CRS}, {IATI})) * (count(*) - 1) / (count(*) - 2) END, 6) AS adj_r2,
       count(*) AS n
FROM merged WHERE {CRS} IS NOT NULL AND {IATI} IS NOT NULL
GROUP BY donor_name""")
def donor_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per donor ``A = alpha + beta·B`` over reconciled rows with both sides."""
    m = merged_panel(tables(spark, sf_dir))
    f = ols.grouped_simple(m, "donor_name", CRS, IATI)
    return f.select("donor_name", _r6("alpha").alias("alpha"), _r6("beta").alias("beta"),
                    _r6("adj_r2").alias("adj_r2"), "n")


@register("donors_without_fit", ("Q4",), _MERGED + f"""
SELECT donor_name FROM merged GROUP BY donor_name
HAVING max(CASE WHEN {CRS} IS NOT NULL AND {IATI} IS NOT NULL THEN 1 ELSE 0 END) = 0""")
def donors_without_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ols.groups_without_pairs(merged_panel(tables(spark, sf_dir)), "donor_name", CRS, IATI)


# ------------------------------------------------------------- panel OLS (M2)

def _moments_sql(src: str, y: str, xs: list[str], where: str) -> str:
    k = len(xs)
    parts = ["count(*) AS n", f"avg({y}) AS m_y"] + [f"avg({x}) AS m_{i}" for i, x in enumerate(xs)]
    for i in range(k):
        for j in range(i, k):
            parts.append(f"covar_pop({xs[i]}, {xs[j]}) * count(*) AS s_{i}{j}")
        parts.append(f"covar_pop({xs[i]}, {y}) * count(*) AS s_{i}y")
    parts.append(f"var_pop({y}) * count(*) AS s_yy")
    return f"SELECT {', '.join(parts)} FROM {src} WHERE {where}"


def _complete(cols: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def _model_sql(train_where: str, name: str) -> tuple[str, str]:
    mom = f"{name}_m AS ({_moments_sql('kpanel', CRS, XS, train_where + ' AND ' + _complete([CRS] + XS))})"
    ctes, last = _cte_chain(f"{name}_m", ols.fit_steps(len(XS)), f"{name}_f")
    return ",\n".join([mom] + ctes), last


def keyword_model(p: DataFrame, train_max_year: int) -> DataFrame:
    return ols.fit(p.filter(F.col("year") < train_max_year), CRS, XS)


_M2_SQL, _M2_LAST = _model_sql(f"year < {NOWCAST_YEAR}", "km")
_TERMS = ["(Intercept)", IATI, f"{CRS}_t1", "delta_iati"]


@register("panel_ols_coefs", ("M2", "M6"), W_PANEL + ",\n" + _M2_SQL + f"""
SELECT u.term, round(u.estimate, 6) AS estimate, round(u.std_error, 6) AS std_error,
       round(u.estimate / nullif(u.std_error, 0), 6) AS t_value,
       CAST(n AS BIGINT) AS nobs, round(adj_r2, 6) AS adj_r2, CAST(df_resid AS BIGINT) AS df_resid
FROM {_M2_LAST},
LATERAL (VALUES ('{_TERMS[0]}', b_c, se_c), ('{_TERMS[1]}', b_0, se_0),
                ('{_TERMS[2]}', b_1, se_1), ('{_TERMS[3]}', b_2, se_2)) u(term, estimate, std_error)""")
def panel_ols_coefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ~ 1 + B + A_lag + ΔB on the dense panel, trained before the nowcast year."""
    model = keyword_model(keyword_panel(tables(spark, sf_dir), materialize=True), NOWCAST_YEAR)
    s = ols.summary(model, _TERMS[1:])
    return s.select("term", *[_r6(c).alias(c) for c in ["estimate", "std_error", "t_value"]],
                    "nobs", _r6("adj_r2").alias("adj_r2"), "df_resid")


def _predict_sql(src: str, model: str, prefix: str) -> tuple[str, str]:
    ctes, last = _cte_chain(f"{prefix}_in", ols.predict_exprs(XS), prefix)
    head = f"{prefix}_in AS (SELECT p.*, m.* FROM {src} p, {model} m)"
    return ",\n".join([head] + ctes), last


_NOW_SQL, _NOW_LAST = _predict_sql("kpanel", _M2_LAST, "kp")


def nowcast(t: Tables) -> DataFrame:
    """Panel rows with fit/lwr/upr; A replaced by the fit in the nowcast year."""
    return nowcast_of(keyword_panel(t, materialize=True))


def nowcast_of(p: DataFrame) -> DataFrame:
    """:func:`nowcast` of a stored panel."""
    model = keyword_model(p, NOWCAST_YEAR)
    pred = ols.predict(p, model, XS)
    return pred.withColumn(CRS, F.when(F.col("year") == NOWCAST_YEAR, F.col("fit")).otherwise(F.col(CRS)))


@register("nowcast_band", ("M4", "P23"), W_PANEL + ",\n" + _M2_SQL + ",\n" + _NOW_SQL + f"""
SELECT recipient_iso3_code, year,
       round(CASE WHEN year = {NOWCAST_YEAR} THEN fit ELSE {CRS} END, 8) AS {CRS},
       round(fit, 6) AS fit, round(lwr, 6) AS lwr, round(upr, 6) AS upr
FROM {_NOW_LAST}""")
def nowcast_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nowcast(tables(spark, sf_dir))
    # Actual values have 8 decimals: rounding to 8 is exact, so engines that
    # summed in a different order still agree; model outputs are rounded to 6.
    return n.select("recipient_iso3_code", "year", F.round(CRS, 8).alias(CRS),
                    *[_r6(c).alias(c) for c in ["fit", "lwr", "upr"]])


_HM_SQL, _HM_LAST = _model_sql(f"year < {LAST_ACTUAL_YEAR}", "hm")
_HP_SQL, _HP_LAST = _predict_sql("kpanel", _HM_LAST, "hp")


@register("holdout_rmse", ("M5", "A12"), W_PANEL + ",\n" + _HM_SQL + ",\n" + _HP_SQL + f""",
test AS (SELECT * FROM {_HP_LAST} WHERE year = {LAST_ACTUAL_YEAR}),
agg AS (SELECT sum({CRS}) AS a, sum({IATI}) AS b, sum(fit) AS f FROM test)
SELECT round(sqrt(avg(({CRS} - {IATI}) * ({CRS} - {IATI}))), 6) AS rmse_raw,
       round(sqrt(avg(({CRS} - fit) * ({CRS} - fit))), 6) AS rmse_fit,
       (SELECT round(sqrt((a - b) * (a - b)), 6) FROM agg) AS rmse_raw_total,
       (SELECT round(sqrt((a - f) * (a - f)), 6) FROM agg) AS rmse_fit_total
FROM test""")
def holdout_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train before the last actual year, test on it: RMSE of B alone and of
    the model against A, per row and for the year total."""
    p = keyword_panel(tables(spark, sf_dir), materialize=True)
    model = keyword_model(p, LAST_ACTUAL_YEAR)
    test = ols.predict(p, model, XS).filter(F.col("year") == LAST_ACTUAL_YEAR)
    rows = test.agg(rollups.rmse(CRS, IATI).alias("rmse_raw"), rollups.rmse(CRS, "fit").alias("rmse_fit"))
    tot = test.agg(F.sum(CRS).alias("a"), F.sum(IATI).alias("b"), F.sum("fit").alias("f"))
    tot = tot.select(F.sqrt((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("rmse_raw_total"),
                     F.sqrt((F.col("a") - F.col("f")) * (F.col("a") - F.col("f"))).alias("rmse_fit_total"))
    out = attach_scalars(rows, tot)
    return out.select(*[_r6(c).alias(c) for c in ["rmse_raw", "rmse_fit", "rmse_raw_total", "rmse_fit_total"]])


# -------------------------------------------------- fixed-effects panel (M3)

FE_XS = [IATI, f"{CRS}_t1", "delta_iati", "year_x"]
FE_NAMES = [IATI, f"{CRS}_t1", "delta_iati", "year"]


def sector_panel(t: Tables, materialize: bool = True) -> DataFrame:
    """Recipient × sector × year panel (full product), with lags and ΔB;
    written once as an intermediate table (five aggregates and the
    prediction read it)."""
    if materialize:
        from lintel.sources.warehouse import materialized
        return materialized(t, "sector_panel", lambda tt: sector_panel(tt, materialize=False))
    m = merged_panel(t)
    p0 = rollups.sum_by(m, ["year", "sector_code", "recipient_iso3_code"], {CRS: CRS, IATI: IATI})
    d = panel.expand_grid(p0, ["recipient_iso3_code", "sector_code"], "year", [CRS, IATI])
    d = panel.with_lags(d, ["recipient_iso3_code", "sector_code"], "year", [CRS, IATI])
    d = panel.with_difference(d, IATI, f"{IATI}_t1", "delta_iati")
    return d.withColumn("year_x", F.col("year").cast("double"))


def fe_model(p: DataFrame, train_max_year: int) -> tuple[DataFrame, DataFrame]:
    cols = [CRS, *FE_XS]
    complete = p
    for c in cols:
        complete = complete.filter(F.col(c).isNotNull())
    train = complete.filter(F.col("year") < train_max_year)
    train_dm = ols.fe_demean(train, train, "recipient_iso3_code", "sector_code", cols)
    model = ols.fe_fit(train_dm, CRS, FE_XS, "recipient_iso3_code", "sector_code", "year")
    return complete, model.withColumn("_train_max", F.lit(train_max_year))


SQL_SPANEL = f"""sp0 AS (
  SELECT year, sector_code, recipient_iso3_code,
         coalesce(sum({CRS}), 0) AS {CRS}, coalesce(sum({IATI}), 0) AS {IATI}
  FROM merged GROUP BY ALL
),
sgrid AS (SELECT r.recipient_iso3_code, s.sector_code, y.year
          FROM (SELECT DISTINCT recipient_iso3_code FROM sp0) r, (SELECT DISTINCT sector_code FROM sp0) s,
               (SELECT DISTINCT year FROM sp0) y),
sdense AS (
  SELECT g.recipient_iso3_code, g.sector_code, g.year,
         coalesce(p.{CRS}, 0) AS {CRS}, coalesce(p.{IATI}, 0) AS {IATI}
  FROM sgrid g LEFT JOIN sp0 p ON g.recipient_iso3_code = p.recipient_iso3_code
   AND g.sector_code = p.sector_code AND g.year = p.year
),
spanel AS (
  SELECT *, lag({CRS}) OVER w AS {CRS}_t1, lag({IATI}) OVER w AS {IATI}_t1,
         {IATI} - lag({IATI}) OVER w AS delta_iati, CAST(year AS DOUBLE) AS year_x
  FROM sdense WINDOW w AS (PARTITION BY recipient_iso3_code, sector_code ORDER BY year)
),
scomplete AS (SELECT * FROM spanel WHERE {_complete([CRS] + FE_XS)})"""


def _fe_sql(train_max: int, name: str) -> tuple[str, str]:
    cols = [CRS, *FE_XS]
    a = ", ".join(f"avg({c}) AS a_{c}" for c in cols)
    b = ", ".join(f"avg({c}) AS b_{c}" for c in cols)
    o = ", ".join(f"avg({c}) AS o_{c}" for c in cols)
    dm = ", ".join(f"{c} - a_{c} - b_{c} + o_{c} AS {c}_dm, a_{c} + b_{c} - o_{c} AS {c}_off" for c in cols)
    ctes = [
        f"{name}_tr AS (SELECT * FROM scomplete WHERE year < {train_max})",
        f"{name}_a AS (SELECT recipient_iso3_code, {a} FROM {name}_tr GROUP BY 1)",
        f"{name}_b AS (SELECT sector_code, {b} FROM {name}_tr GROUP BY 1)",
        f"{name}_o AS (SELECT {o} FROM {name}_tr)",
        f"""{name}_dm AS (SELECT x.*, {dm} FROM scomplete x
             LEFT JOIN {name}_a USING (recipient_iso3_code) LEFT JOIN {name}_b USING (sector_code), {name}_o)""",
    ]
    xdm = [f"{x}_dm" for x in FE_XS]
    mom = _moments_sql(f"{name}_dm", f"{CRS}_dm", xdm, f"year < {train_max}")
    ctes.append(f"""{name}_m AS (SELECT * FROM ({mom}) mm,
        (SELECT count(DISTINCT recipient_iso3_code) AS n_g1, count(DISTINCT sector_code) AS n_g2,
                count(DISTINCT year) AS n_t, var_pop({CRS}) * count(*) AS s_yy_raw
         FROM {name}_tr) ee)""")
    chain, last = _cte_chain(f"{name}_m", ols.fit_steps(len(FE_XS), "n_g1 + n_g2 - 2", "s_yy_raw"), f"{name}_f")
    return ",\n".join(ctes + chain), last


W_SPANEL = _MERGED.rstrip() + ",\n" + SQL_SPANEL
_FE_SQL, _FE_LAST = _fe_sql(NOWCAST_YEAR, "fe")


@register("fixed_effect_ols", ("M3", "M6", "J8"), W_SPANEL + ",\n" + _FE_SQL + f"""
SELECT u.term, round(u.estimate, 6) AS estimate, round(u.std_error, 6) AS std_error,
       round(u.estimate / nullif(u.std_error, 0), 6) AS t_value,
       CAST(n AS BIGINT) AS nobs, round(adj_r2, 6) AS adj_r2, CAST(df_resid AS BIGINT) AS df_resid,
       n = n_g1 * n_g2 * n_t AS balanced
FROM {_FE_LAST},
LATERAL (VALUES ('{FE_NAMES[0]}', b_0, se_0), ('{FE_NAMES[1]}', b_1, se_1),
                ('{FE_NAMES[2]}', b_2, se_2), ('{FE_NAMES[3]}', b_3, se_3)) u(term, estimate, std_error)""")
def fixed_effect_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ~ B + A_lag + ΔB + year + recipient FE + sector FE, by exact
    two-way demeaning of the balanced panel (4×4 normal equations)."""
    _, model = fe_model(sector_panel(tables(spark, sf_dir)), NOWCAST_YEAR)
    s = ols.summary(model.withColumn("balanced", F.col("balanced")), FE_NAMES, intercept=False)
    bal = model.select("balanced")
    s = attach_scalars(s, bal)
    return s.select("term", *[_r6(c).alias(c) for c in ["estimate", "std_error", "t_value"]],
                    "nobs", _r6("adj_r2").alias("adj_r2"), "df_resid", "balanced")


_FEP_CHAIN, _FEP_LAST = _cte_chain("fep_in", ols.predict_exprs([f"{x}_dm" for x in FE_XS], ols.FE_LEVERAGE), "fep")


@register("fixed_effect_nowcast", ("M3", "M4", "P23"), W_SPANEL + ",\n" + _FE_SQL + ",\n" +
          f"fep_in AS (SELECT p.*, m.* FROM fe_dm p, {_FE_LAST} m WHERE p.year = {NOWCAST_YEAR})" + ",\n" +
          ",\n".join(_FEP_CHAIN) + f"""
SELECT recipient_iso3_code, sector_code, year,
       round(fit + {CRS}_off, 6) AS fit, round(lwr + {CRS}_off, 6) AS lwr, round(upr + {CRS}_off, 6) AS upr
FROM {_FEP_LAST}""")
def fixed_effect_nowcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nowcast-year fit and 95 % band per (recipient, sector) cell."""
    pred = fe_nowcast(tables(spark, sf_dir))
    return pred.select("recipient_iso3_code", "sector_code", "year",
                       *[_r6(c).alias(c) for c in ["fit", "lwr", "upr"]])


def fe_nowcast(t: Tables) -> DataFrame:
    """(recipient, sector, year, fit, lwr, upr) for the nowcast year."""
    p = sector_panel(t)
    complete, model = fe_model(p, NOWCAST_YEAR)
    train = complete.filter(F.col("year") < NOWCAST_YEAR)
    rows = ols.fe_demean(train, complete.filter(F.col("year") == NOWCAST_YEAR),
                         "recipient_iso3_code", "sector_code", [CRS, *FE_XS])
    pred = ols.fe_predict(rows, model, CRS, FE_XS)
    return pred.select("recipient_iso3_code", "sector_code", "year", "fit", "lwr", "upr")


# SQL of the nowcast rows, for reports built on them (CTE ``fe_now``).
SQL_FE_NOW = (W_SPANEL + ",\n" + _FE_SQL + ",\n" +
              f"fep_in AS (SELECT p.*, m.* FROM fe_dm p, {_FE_LAST} m WHERE p.year = {NOWCAST_YEAR})" + ",\n" +
              ",\n".join(_FEP_CHAIN) + f""",
fe_now AS (SELECT recipient_iso3_code, sector_code, year, fit + {CRS}_off AS fit,
                  lwr + {CRS}_off AS lwr, upr + {CRS}_off AS upr FROM {_FEP_LAST})""")
