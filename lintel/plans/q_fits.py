"""Fits with dropped regressors, tail probabilities, rolling cutoffs, unbalanced panels, quantiles of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators import ols, quantiles, rolling, sweep, two_way
from lintel.plans.common import LAST_ACTUAL_YEAR, NOWCAST_YEAR, merged_panel, tables
from lintel.plans.q_models import (CRS, FE_XS, IATI, W_PANEL, W_SPANEL, XS, _complete, _cte_chain, _fe_sql, _model_sql,
                                   _moments_sql, _predict_sql, _r6, keyword_panel, sector_panel)
from lintel.plans.registry import register

CUTOFFS = range(LAST_ACTUAL_YEAR - 2, LAST_ACTUAL_YEAR + 1)


def t_p_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t as its finite sum over whole degrees of freedom."""
    cos2, sin = f"({df} / ({df} + {t} * {t}))", f"(abs({t}) / sqrt({df} + {t} * {t}))"
    power = f"CASE WHEN k = 0 THEN 1 ELSE pow({cos2}, k) END"
    even = (f"{sin} * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5)"
            f" - lgamma(0.5) - lgamma(k + 1)) * {power}))")
    odd = (f"2 / pi() * (asin({sin}) + {sin} * sqrt({cos2}) * coalesce(list_sum(list_transform("
           f"range(0, CAST(({df} - 1) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5))"
           f" * {power})), 0))")
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def f_p_sql(f: str, df1: int, df2: str) -> str:
    """Upper tail of F for an odd ``df1``: that of t squared, and a term for each two degrees more."""
    out = t_p_sql(f"sqrt({df1} * {f})", df2)
    x, y = f"({df2} / ({df2} + {df1} * {f}))", f"({df1} * {f} / ({df2} + {df1} * {f}))"
    for k in range(1, df1, 2):
        b = k / 2
        out += (f" + exp({df2} / 2.0 * ln({x}) + {b} * ln({y}) + lgamma({df2} / 2.0 + {b}) - lgamma({df2} / 2.0)"
                f" - lgamma({b})) / {b}")
    return f"({out})"


def _terms_sql(names: list[str]) -> str:
    rows = ["('(Intercept)', b_c, se_c)"] + [f"('{n}', b_{i}, se_{i})" for i, n in enumerate(names)]
    return f"LATERAL (VALUES {', '.join(rows)}) u(term, estimate, std_error)"


def _columns_sql(k: int) -> str:
    t = "(u.estimate / u.std_error)"
    f = f"((s_yy - rss) / {k} / s2)"
    return f"""u.term, round(u.estimate, 6) AS estimate, round(u.std_error, 6) AS std_error,
       round({t}, 6) AS t_value, round({t_p_sql(t, 'df_resid')}, 6) AS p_value,
       round(u.estimate - tq * u.std_error, 5) AS lwr, round(u.estimate + tq * u.std_error, 5) AS upr,
       false AS aliased, CAST(n AS BIGINT) AS nobs, round(adj_r2, 6) AS adj_r2,
       CAST(df_resid AS BIGINT) AS df_resid, round({f_p_sql(f, k, 'df_resid') if k % 2 else 'NULL'}, 6) AS f_p_value"""


def _summary(model: DataFrame, names: list[str]) -> DataFrame:
    s = sweep.summary(model, names)
    return s.select("term", *[_r6(c).alias(c) for c in ("estimate", "std_error", "t_value", "p_value")],
                    F.round("lwr", 5).alias("lwr"), F.round("upr", 5).alias("upr"), "aliased", "nobs",
                    _r6("adj_r2").alias("adj_r2"), "df_resid", _r6("f_p_value").alias("f_p_value"))


_M_SQL, _M_LAST = _model_sql(f"year < {NOWCAST_YEAR}", "ps")


@register("panel_ols_summary", ("M2", "M6"), W_PANEL + ",\n" + _M_SQL + f"""
SELECT {_columns_sql(len(XS))} FROM {_M_LAST}, {_terms_sql(XS)}""")
def panel_ols_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel fit with p-values, 95 % intervals and the p-value of F."""
    p = keyword_panel(tables(spark, sf_dir), materialize=True).filter(F.col("year") < NOWCAST_YEAR)
    return _summary(sweep.fit(p, CRS, XS), XS)


# B of the year before is B less its difference, so it adds nothing: it is dropped and named.
WIDE = [*XS, f"{IATI}_t1", "year_x", "year_x2"]
_KEPT = [*XS, "year_x", "year_x2"]
_WIDE_CTE = "kwide AS (SELECT *, CAST(year - 1995 AS DOUBLE) AS year_x, CAST((year - 1995) * (year - 1995) AS DOUBLE) AS year_x2 FROM kpanel)"
_WIDE_FIT, _WIDE_LAST = _cte_chain("wm", ols.fit_steps(len(_KEPT)), "wf")


@register("panel_ols_aliased", ("M2", "M6"), W_PANEL + f""",
{_WIDE_CTE},
wm AS ({_moments_sql('kwide', CRS, _KEPT, f"year < {NOWCAST_YEAR} AND {_complete([CRS, *WIDE])}")}),
{(','+chr(10)).join(_WIDE_FIT)}
SELECT {_columns_sql(len(_KEPT))} FROM {_WIDE_LAST}, {_terms_sql(_KEPT)}
UNION ALL
SELECT '{IATI}_t1', NULL, NULL, NULL, NULL, NULL, NULL, true, CAST(n AS BIGINT), round(adj_r2, 6),
       CAST(df_resid AS BIGINT), round({f_p_sql(f"((s_yy - rss) / {len(_KEPT)} / s2)", len(_KEPT), 'df_resid')}, 6)
FROM {_WIDE_LAST}""")
def panel_ols_aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six regressors, one of them a difference of two others: it is named as aliased."""
    p = keyword_panel(tables(spark, sf_dir), materialize=True).filter(F.col("year") < NOWCAST_YEAR)
    x = (F.col("year") - 1995).cast("double")
    return _summary(sweep.fit(p.withColumn("year_x", x).withColumn("year_x2", x * x), CRS, WIDE), WIDE)


# ------------------------------------------------------------- validation

def _rolling_sql() -> str:
    ctes, rows = [], []
    for c in CUTOFFS:
        model, last = _model_sql(f"year < {c}", f"ra{c}")
        fit, done = _predict_sql("kpanel", last, f"rb{c}")
        ctes += [model, fit]
        rows.append(f"""SELECT year, CAST(max(n) AS BIGINT) AS n_train, count(*) AS n_test,
  round(sqrt(avg(({CRS} - {IATI}) * ({CRS} - {IATI}))), 6) AS rmse_raw,
  round(sqrt(avg(({CRS} - fit) * ({CRS} - fit))), 6) AS rmse_fit FROM {done} WHERE year = {c} AND {_complete([CRS, *XS])}
GROUP BY year""")
    return ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(rows)


@register("rolling_origin_rmse", ("M5", "A12"), W_PANEL + ",\n" + _rolling_sql())
def rolling_origin_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the last three actual years predicted from all years before it, by one scan's moments."""
    p = keyword_panel(tables(spark, sf_dir), materialize=True)
    out = rolling.validate(p, CRS, XS, "year", IATI).filter(F.col("year").isin(list(CUTOFFS)))
    return out.select("year", "n_train", "n_test", _r6("rmse_raw").alias("rmse_raw"), _r6("rmse_fit").alias("rmse_fit"))


def _rolling_fe_sql() -> str:
    ctes, rows = [], []
    fit = "b_c + " + " + ".join(f"b_{i} * {x}_dm" for i, x in enumerate(FE_XS)) + f" + {CRS}_off"
    for c in CUTOFFS:
        model, last = _fe_sql(c, f"rf{c}")
        ctes.append(model)
        rows.append(f"""SELECT year, CAST(max(n) AS BIGINT) AS n_train, count(*) AS n_test,
  bool_and(n = n_g1 * n_g2 * n_t) AS balanced,
  round(sqrt(avg(({CRS} - {IATI}) * ({CRS} - {IATI}))), 6) AS rmse_raw,
  round(sqrt(avg(({CRS} - ({fit})) * ({CRS} - ({fit})))), 6) AS rmse_fit
FROM rf{c}_dm, {last} WHERE year = {c} GROUP BY year""")
    return ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(rows)


@register("rolling_origin_fixed_effects", ("M3", "M5", "A12"), W_SPANEL + ",\n" + _rolling_fe_sql())
def rolling_origin_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rolling_origin_rmse, on the sector panel with recipient and sector effects."""
    p = sector_panel(tables(spark, sf_dir))
    out = rolling.validate_two_way(p, CRS, FE_XS, "recipient_iso3_code", "sector_code", "year", IATI)
    out = out.filter(F.col("year").isin(list(CUTOFFS)))
    return out.select("year", "n_train", "n_test", "balanced", _r6("rmse_raw").alias("rmse_raw"),
                      _r6("rmse_fit").alias("rmse_fit"))


# ------------------------------------------------------- unbalanced panels

@register("fixed_effect_unbalanced", ("M3", "M6"), None)
def fixed_effect_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ~ B + year with recipient and donor effects, on the cells that both sources report: no grid is filled."""
    m = merged_panel(tables(spark, sf_dir)).filter(F.col("year") < NOWCAST_YEAR)
    rows = m.withColumn("year_x", (F.col("year") - 1995).cast("double"))
    fit = two_way.Fit(rows, CRS, [IATI, "year_x"], "recipient_iso3_code", "donor_name")
    s = fit.summary([IATI, "year"])
    return s.select("term", *[_r6(c).alias(c) for c in ("estimate", "std_error", "t_value", "p_value", "lwr", "upr")],
                    "nobs", "df_resid", _r6("adj_r2").alias("adj_r2"), F.lit(fit.absorbed).cast("bigint").alias("absorbed"))


# ------------------------------------------------------- quantiles of facts

PS = (0.0, 0.1, 0.2, 0.5, 0.8, 0.9, 1.0)


@register("line_value_quantiles", ("A10",), "\nUNION ALL\n".join(
    f"SELECT CAST({p} AS DOUBLE) AS p, round(quantile_cont(CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS"
    f" DOUBLE)), {p}), 4) AS value FROM lineitem" for p in PS))
def line_value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the discounted value of all line items."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    value = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))
    out = quantiles.exact_quantiles(items.select(value.alias("value")), "value", PS)
    return out.select("p", F.round("value", 4).alias("value"))
