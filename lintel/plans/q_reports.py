"""Steps 4 and 9: deflated nowcast roll-ups, the two-definition comparison,
country attributes, formatted labels and the report bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import columns as C
from lintel.operators import joins, rollups, text
from lintel.operators.joins import attach_scalars, dedupe_lookup, lookup_left
from lintel.plans import q_rollups  # noqa: F401  (the bundle names its queries)
from lintel.plans.common import (DEFLATORS, NOWCAST_YEAR, SECTOR_DEFINITION, SQL_FACT_A_CLEAN, fact_a_clean, r4,
                                 tables)
from lintel.plans.oracle_views import VIEWS
from lintel.plans.q_models import _M2_SQL, _NOW_LAST, _NOW_SQL, CRS, SQL_FE_NOW, W_PANEL, fe_nowcast, nowcast
from lintel.plans.registry import ORACLE, QUERIES, register
from lintel.session import scratch_path
from lintel.sources import files, views
from lintel.sources.keywords import FACT_KEYWORDS
from lintel.sources.tables import Tables

MEASURE = "usd_disbursement_deflated"
LWR, UPR = "usd_disbursement_lwr", "usd_disbursement_upr"
DEFLATOR_ROW = "TOTAL DAC"
SUFFIXES = (", regional", ", unspecified")
# The "unspecified" recipient dropped from the country comparison.
UNSPECIFIED_ISO = "N20"

_DEFL_VALUES = ", ".join(f"('{n}', {y}, CAST({d} AS DOUBLE))" for n, y, d in DEFLATORS)
SQL_DEFL = f"""defl AS (SELECT 1.0 / d AS f FROM (VALUES {_DEFL_VALUES}) v(name, yr, d)
                WHERE name = '{DEFLATOR_ROW}' AND yr = {NOWCAST_YEAR})"""
SQL_NAMES_LU = """names_lu AS (SELECT recipient_iso3_code, min(recipient_name) AS recipient_name
                   FROM recipient_names GROUP BY 1)"""
SQL_MODELLED = f"""modelled AS (
  SELECT n.recipient_iso3_code, n.year,
         CASE WHEN n.fit * d.f < 0 THEN 0 ELSE n.fit * d.f END AS v,
         CASE WHEN n.lwr * d.f < 0 THEN 0 ELSE n.lwr * d.f END AS lo,
         CASE WHEN n.upr * d.f < 0 THEN 0 ELSE n.upr * d.f END AS hi
  FROM {_NOW_LAST} n, defl d WHERE n.year = {NOWCAST_YEAR}
)"""

_W_MOD = (W_PANEL + ",\n" + _M2_SQL + ",\n" + _NOW_SQL + ",\n" + SQL_DEFL + ",\n" + SQL_MODELLED + ",\n"
          + VIEWS["recipient_names"].strip() + ",\n" + SQL_NAMES_LU)


def deflator_factor(t: Tables) -> DataFrame:
    """One-row frame ``f = 1 / deflator`` of the chosen row and year."""
    d = t.spark.createDataFrame(list(DEFLATORS), "name string, yr int, d double")
    return (d.filter((F.col("name") == DEFLATOR_ROW) & (F.col("yr") == NOWCAST_YEAR))
            .select((F.lit(1.0) / F.col("d")).alias("f")))


def modelled_rows(t: Tables) -> DataFrame:
    """Nowcast-year rows: fit and band deflated (P11, J11) and clamped at 0
    (P10, all three measures)."""
    return deflated(t, nowcast(t).filter(F.col("year") == NOWCAST_YEAR), "recipient_iso3_code", "year")


def deflated(t: Tables, fitted: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the deflated, clamped value and band of fitted rows."""
    n = attach_scalars(fitted, deflator_factor(t))
    return n.select(*keys,
                    C.clamp_nonneg(C.scale("fit", "f")).alias("v"),
                    C.clamp_nonneg(C.scale("lwr", "f")).alias("lo"),
                    C.clamp_nonneg(C.scale("upr", "f")).alias("hi"))


def recipient_name_lookup(t: Tables) -> DataFrame:
    return dedupe_lookup(views.recipient_names(t), "recipient_iso3_code")


@register("clamp_and_deflate", ("S4", "P10", "P11", "J11", "J1", "A3"), _W_MOD + f"""
SELECT m.year, l.recipient_name, round(coalesce(sum(m.v), 0), 6) AS {MEASURE},
       round(coalesce(sum(m.lo), 0), 6) AS {LWR}, round(coalesce(sum(m.hi), 0), 6) AS {UPR}
FROM modelled m LEFT JOIN names_lu l ON m.recipient_iso3_code = l.recipient_iso3_code
GROUP BY m.year, l.recipient_name""")
def clamp_and_deflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nowcast-year value and band per recipient name, in constant prices."""
    t = tables(spark, sf_dir)
    m = lookup_left(modelled_rows(t), recipient_name_lookup(t), "recipient_iso3_code")
    out = rollups.sum_by(m, ["year", "recipient_name"], {MEASURE: "v", LWR: "lo", UPR: "hi"})
    return out.select("year", "recipient_name", *[F.round(c, 6).alias(c) for c in (MEASURE, LWR, UPR)])


_SQL_ACT = f"""act AS (SELECT year, coalesce(sum({MEASURE}), 0) AS v FROM fact_a_clean GROUP BY year)"""


@register("actuals_plus_modelled", ("G2", "A1", "A3"), _W_MOD + ",\n" + _SQL_ACT + f"""
SELECT year, round(v, 4) AS {MEASURE}, CAST(NULL AS DOUBLE) AS {LWR}, CAST(NULL AS DOUBLE) AS {UPR} FROM act
UNION ALL
SELECT year, round(coalesce(sum(v), 0), 4), round(coalesce(sum(lo), 0), 4), round(coalesce(sum(hi), 0), 4)
FROM modelled GROUP BY year""")
def actuals_plus_modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual years (no band) stacked with the modelled year (value and band)."""
    t = tables(spark, sf_dir)
    act = rollups.sum_by(fact_a_clean(t), ["year"], {MEASURE: "usd_disbursement_deflated"})
    mod = rollups.sum_by(modelled_rows(t), ["year"], {MEASURE: "v", LWR: "lo", UPR: "hi"})
    out = rollups.union_fill(act, mod)
    return out.select("year", *[r4(c).alias(c) for c in (MEASURE, LWR, UPR)])


_QS = (0.0, 0.1, 0.2, 0.8, 0.9, 1.0)


@register("recipient_quantiles", ("A10", "G2", "A5"), _W_MOD + f""",
per AS (
  SELECT recipient_iso3_code, sum(v) AS v FROM (
    SELECT recipient_iso3_code, {MEASURE} AS v FROM fact_a_clean
    UNION ALL SELECT recipient_iso3_code, v FROM modelled) GROUP BY 1
),
q AS (SELECT quantile_cont(v, [{", ".join(str(p) for p in _QS)}]) AS q FROM per)
SELECT {", ".join(f"round(q[{i + 1}], 4) AS q{int(round(p * 100)):03d}" for i, p in enumerate(_QS))} FROM q""")
def recipient_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles (linear interpolation) of per-recipient totals of
    actual and modelled values."""
    t = tables(spark, sf_dir)
    act = fact_a_clean(t).select("recipient_iso3_code", F.col(MEASURE).alias("v"))
    mod = modelled_rows(t).select("recipient_iso3_code", "v")
    per = rollups.sum_by(act.unionByName(mod), ["recipient_iso3_code"], {"v": "v"})
    q = rollups.exact_quantiles(per, "v", _QS)
    return q.select(*[r4(c).alias(c) for c in q.columns])


@register("sector_nowcast_by_purpose", ("M3", "M4", "P11", "P10", "A3", "J11"), SQL_FE_NOW + ",\n" + SQL_DEFL + f""",
cl AS (SELECT sector_code, year,
              CASE WHEN fit * f < 0 THEN 0 ELSE fit * f END AS v,
              CASE WHEN lwr * f < 0 THEN 0 ELSE lwr * f END AS lo,
              CASE WHEN upr * f < 0 THEN 0 ELSE upr * f END AS hi
       FROM fe_now, defl)
SELECT 'Purpose ' || sector_code AS purpose_name, year,
       round(coalesce(sum(v), 0), 6) AS {MEASURE}, round(coalesce(sum(lo), 0), 6) AS {LWR},
       round(coalesce(sum(hi), 0), 6) AS {UPR}
FROM cl GROUP BY ALL""")
def sector_nowcast_by_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector definition: the fixed-effects nowcast per cell, deflated and
    clamped, summed per purpose (value and band)."""
    t = tables(spark, sf_dir)
    n = attach_scalars(fe_nowcast(t), deflator_factor(t))
    n = n.select(F.concat(F.lit("Purpose "), F.col("sector_code")).alias("purpose_name"), "year",
                 C.clamp_nonneg(C.scale("fit", "f")).alias("v"),
                 C.clamp_nonneg(C.scale("lwr", "f")).alias("lo"),
                 C.clamp_nonneg(C.scale("upr", "f")).alias("hi"))
    out = rollups.sum_by(n, ["purpose_name", "year"], {MEASURE: "v", LWR: "lo", UPR: "hi"})
    return out.select("purpose_name", "year", *[F.round(c, 6).alias(c) for c in (MEASURE, LWR, UPR)])


@register("recipient_totals_ranked", ("G2", "J1", "A5", "O1"), _W_MOD + f""",
rows_ AS (
  SELECT recipient_name, {MEASURE} AS v FROM fact_a_clean
  UNION ALL
  SELECT l.recipient_name, m.v FROM modelled m LEFT JOIN names_lu l ON m.recipient_iso3_code = l.recipient_iso3_code
)
SELECT recipient_name, round(coalesce(sum(v), 0), 4) AS {MEASURE} FROM rows_ GROUP BY recipient_name""")
def recipient_totals_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual years plus the modelled year, per recipient name, largest first."""
    t = tables(spark, sf_dir)
    act = fact_a_clean(t).select("recipient_name", F.col(MEASURE).alias("v"))
    mod = lookup_left(modelled_rows(t), recipient_name_lookup(t), "recipient_iso3_code").select("recipient_name", "v")
    out = rollups.sum_by(act.unionByName(mod), ["recipient_name"], {MEASURE: "v"})
    return rollups.order_desc(out.select("recipient_name", r4(MEASURE).alias(MEASURE)), MEASURE, ["recipient_name"])


# ------------------------------------------------------ definition comparison

def _by_country(df: DataFrame) -> DataFrame:
    """Per-country totals with the band seeded from the value."""
    f = df.filter(C.ends_with_none("recipient_name", SUFFIXES))
    g = rollups.sum_by(f, ["recipient_iso3_code"], {MEASURE: MEASURE})
    g = g.withColumn(LWR, F.col(MEASURE)).withColumn(UPR, F.col(MEASURE))
    return g.withColumnRenamed("recipient_iso3_code", "iso_3")


def comparison(t: Tables) -> DataFrame:
    fa = fact_a_clean(t)
    purpose = _by_country(fa.filter(F.col("purpose_code").isin(*SECTOR_DEFINITION)))
    keyword = _by_country(text.screen(fa, ["project_title", "short_description", "long_description"],
                                      FACT_KEYWORDS))
    j = joins.full_with_suffixes(purpose, keyword, "iso_3", ("_purpose", "_keyword"), fill=0.0)
    return j.filter(F.col("iso_3") != UNSPECIFIED_ISO)


_CMP_COLS = [f"{m}_{s}" for s in ("purpose", "keyword") for m in (MEASURE, LWR, UPR)]


def _sql_kw(col: str) -> str:
    from lintel.plans.q_text import sql_kw_regex
    return f"coalesce(regexp_matches(lower({col}), {sql_kw_regex(FACT_KEYWORDS)}), false)"


SQL_CMP = f"""base AS (SELECT * FROM fact_a_clean
              WHERE NOT ends_with(recipient_name, ', regional') AND NOT ends_with(recipient_name, ', unspecified')),
pur AS (SELECT recipient_iso3_code AS iso_3, coalesce(sum({MEASURE}), 0) AS v FROM base
        WHERE purpose_code IN ({", ".join(f"'{p}'" for p in SECTOR_DEFINITION)}) GROUP BY 1),
kwd AS (SELECT recipient_iso3_code AS iso_3, coalesce(sum({MEASURE}), 0) AS v FROM base
        WHERE {_sql_kw('project_title')} OR {_sql_kw('short_description')} OR {_sql_kw('long_description')}
        GROUP BY 1),
cmp AS (SELECT coalesce(p.iso_3, k.iso_3) AS iso_3,
               coalesce(p.v, 0) AS {MEASURE}_purpose, coalesce(p.v, 0) AS {LWR}_purpose,
               coalesce(p.v, 0) AS {UPR}_purpose,
               coalesce(k.v, 0) AS {MEASURE}_keyword, coalesce(k.v, 0) AS {LWR}_keyword,
               coalesce(k.v, 0) AS {UPR}_keyword
        FROM pur p FULL OUTER JOIN kwd k ON p.iso_3 = k.iso_3
        WHERE coalesce(p.iso_3, k.iso_3) <> '{UNSPECIFIED_ISO}')"""

_W_CMP = "WITH " + ",\n".join([VIEWS["nation_codes"].strip(), VIEWS["fact_a"].strip(), SQL_FACT_A_CLEAN, SQL_CMP])


@register("definition_comparison", ("P22", "A3", "J6", "P6", "T1"), _W_CMP + f"""
SELECT iso_3, {", ".join(f"round({c}, 4) AS {c}" for c in _CMP_COLS)} FROM cmp""")
def definition_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per country: the sector definition next to the keyword definition."""
    c = comparison(tables(spark, sf_dir))
    return c.select("iso_3", *[r4(x).alias(x) for x in _CMP_COLS])


@register("feature_properties_join", ("J7", "S7"), _W_CMP + f"""
SELECT coalesce(a.iso_3, c.iso_3) AS iso_3, a.adm0_name1,
       {", ".join(f"round(c.{x}, 4) AS {x}" for x in _CMP_COLS)}
FROM (SELECT iso3 AS iso_3, display_name AS adm0_name1 FROM nation_codes) a
FULL OUTER JOIN cmp c ON a.iso_3 = c.iso_3""")
def feature_properties_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country attributes (the properties of a feature collection) joined to
    the comparison; countries without data are kept with NULL measures."""
    t = tables(spark, sf_dir)
    attrs = views.nation_codes(t).select(F.col("iso3").alias("iso_3"), F.col("display_name").alias("adm0_name1"))
    c = comparison(t)
    j = attrs.join(c, "iso_3", "full")
    return j.select("iso_3", "adm0_name1", *[r4(x).alias(x) for x in _CMP_COLS])


BIN_EDGES = (0, 1, 10, 50, 100, 500, 1000, 1500)


def _sql_money(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN '-$' || printf('%,.1f', -{x}) " \
           f"ELSE '$' || printf('%,.1f', {x}) END"


def _sql_bin(x: str) -> str:
    n = len(BIN_EDGES) - 1
    parts = []
    for i in range(n):
        lo, hi = BIN_EDGES[i], BIN_EDGES[i + 1]
        op = "<=" if i == n - 1 else "<"
        parts.append(f"WHEN {x} >= {lo} AND {x} {op} {hi} THEN '{lo} - {hi}'")
    return "CASE " + " ".join(parts) + " END"


@register("labels_formatted", ("P21", "P20"), _W_CMP + f"""
SELECT iso_3,
       {_sql_money(f'{MEASURE}_purpose')} AS purpose_text,
       {_sql_money(f'{LWR}_purpose')} || ' - ' || {_sql_money(f'{UPR}_purpose')} AS purpose_range,
       {_sql_money(f'{MEASURE}_keyword')} AS keyword_text,
       {_sql_bin(f'{MEASURE}_purpose')} AS purpose_bin,
       {_sql_bin(f'{MEASURE}_keyword')} AS keyword_bin
FROM cmp""")
def labels_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display labels: currency text at 0.1 precision, ranges and bins."""
    c = comparison(tables(spark, sf_dir))
    return c.select("iso_3",
                    C.money_text(f"{MEASURE}_purpose").alias("purpose_text"),
                    C.range_text(f"{LWR}_purpose", f"{UPR}_purpose").alias("purpose_range"),
                    C.money_text(f"{MEASURE}_keyword").alias("keyword_text"),
                    C.bin_label(f"{MEASURE}_purpose", BIN_EDGES).alias("purpose_bin"),
                    C.bin_label(f"{MEASURE}_keyword", BIN_EDGES).alias("keyword_bin"))


# ------------------------------------------------------------- report bundle

BUNDLE = {
    "keyword_by_donor": "total_by_donor",
    "keyword_by_donor_type": "by_donor_type",
    "keyword_by_income": "by_income_group",
    "keyword_year": "actuals_plus_modelled",
    "sector_year": "year_purpose_pivot",
}
BUNDLE_PREFIX = "keyword_"


def _sql_manifest() -> str:
    parts = []
    for report in sorted(BUNDLE):
        if not report.startswith(BUNDLE_PREFIX):
            continue
        parts.append(f"SELECT '{report}' AS report, '@{BUNDLE[report]}' AS columns, "
                     f"(SELECT count(*) FROM ({ORACLE[BUNDLE[report]]}) x) AS n_rows")
    return "\nUNION ALL\n".join(parts)


def report_bundle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the reports whose name starts with ``keyword_`` (anchored) to one
    bundle folder and list them: ``(report, columns, n_rows)``."""
    base = scratch_path(spark, "report_bundle")
    chosen = {r: QUERIES[q](spark, sf_dir) for r, q in BUNDLE.items() if r.startswith(BUNDLE_PREFIX)}
    files.write_report_bundle(chosen, base)
    written = {r: spark.read.parquet(f"{base}/{r}") for r in chosen}
    return files.report_manifest(written, BUNDLE_PREFIX)


def _register_manifest() -> None:
    # Column lists are known only once the builders exist; fill them in the SQL.
    sql = _sql_manifest()
    for report, q in BUNDLE.items():
        cols = {
            "total_by_donor": f"donor_name,{MEASURE}",
            "by_donor_type": f"donor_type,{MEASURE}",
            "by_income_group": f"income_group_name,{MEASURE}",
            "actuals_plus_modelled": f"year,{MEASURE},{LWR},{UPR}",
            "year_purpose_pivot": "year,p_economy,p_large,p_medium,p_promo,p_small,p_standard",
        }[q]
        sql = sql.replace(f"'@{q}'", f"'{cols}'")
    register("report_bundle_manifest", ("S6", "S5"), sql)(report_bundle_manifest)


_register_manifest()

__all__ = ["Tables"]
