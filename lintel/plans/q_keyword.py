"""The keyword definition as a chain over both facts, and its comparison with the sector definition.

Rows whose text holds a keyword are kept unless their text is scored as a
false positive (each distinct text once), both facts are reconciled, the last
year is modelled, and every report is made of the kept actual rows and the
modelled year.  The sector side takes its purposes before the reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import columns as C
from lintel.operators import joins, rollups, text, validity
from lintel.operators.joins import attach_scalars, lookup_left
from lintel.plans.common import (NOWCAST_YEAR, RECONCILE_KEYS, SECTOR_DEFINITION, SQL_A_AGG, SQL_B_AGG, SQL_B_REPAIRED,
                                 SQL_B_SPLIT, SQL_FACT_A_CLEAN, SQL_MAPPING_CLEAN, SQL_MERGED, _b_agg, a_agg,
                                 fact_a_clean, r4, tables)
from lintel.plans.oracle_views import with_views
from lintel.plans.q_models import _M2_SQL, _NOW_SQL, SQL_FE_NOW, SQL_PANEL, fe_nowcast, lagged_panel, nowcast_of
from lintel.plans.q_reports import (_QS, LWR, MEASURE, SQL_DEFL, SQL_MODELLED, SQL_NAMES_LU, SUFFIXES, UNSPECIFIED_ISO,
                                    UPR, _sql_kw, deflated, recipient_name_lookup)
from lintel.plans.q_text import FACT_TEXT, FALSE_POSITIVE_LABEL
from lintel.plans.registry import register
from lintel.session import written
from lintel.sources import views
from lintel.sources.keywords import FACT_KEYWORDS
from lintel.sources.tables import Tables
from lintel.sources.warehouse import materialized

RECIPIENT, GROUP = "recipient_iso3_code", "income_group_name"
BRIEF = text.BRIEF


def kept_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that hold a keyword and are no false positives.

    Fields that are NULL do not match; the text that is scored is the row's
    fields joined by one blank, without the NULL ones.  The rows with a
    keyword are written once: scoring and joining back read only them.
    """
    hits = text.screen(rows, fields, FACT_KEYWORDS).withColumn("_text", F.concat_ws(" ", *fields))
    hits = written(hits, "hits")
    scored = text.join_back(hits, "_text", text.score_distinct(hits, "_text", text.brief_scorer))
    return scored.where(~C.flag_from_label("zs_label", FALSE_POSITIVE_LABEL)).select(*rows.columns)


def keyword_a(t: Tables) -> DataFrame:
    """The kept rows of fact A, written once by year."""
    return materialized(t, "keyword_a", lambda tt: kept_rows(fact_a_clean(tt), FACT_TEXT), partition_by=["year"])


def keyword_merged(t: Tables) -> DataFrame:
    """The kept rows of both facts, reconciled; written once."""
    def build(tt: Tables) -> DataFrame:
        b = _b_agg(tt, kept_rows(views.fact_b_table(tt), ["x_description"]))
        return joins.full_reconcile(a_agg(tt, keyword_a(tt)), b, RECONCILE_KEYS)
    return materialized(t, "keyword_merged", build)


def keyword_modelled(t: Tables) -> DataFrame:
    """(recipient, year, v, lo, hi) of the modelled year, deflated and clamped."""
    p = materialized(t, "keyword_lagged", lambda tt: lagged_panel(keyword_merged(tt)))
    return deflated(t, nowcast_of(p).filter(F.col("year") == NOWCAST_YEAR), RECIPIENT, "year")


def stacked(t: Tables, *keys: str) -> DataFrame:
    """Kept actual values and the modelled year per row, as (``keys``, v)."""
    act = keyword_a(t).select(*keys, F.col(MEASURE).alias("v"))
    return act.unionByName(keyword_modelled(t).select(*keys, "v"))


_KEYWORD_HIT = " OR ".join(_sql_kw(c) for c in FACT_TEXT)
_W_ROWS = with_views("fact_a", "fact_b", "publisher_map", "region_mapping", "iso_table", "recipient_names", extra=[
    SQL_FACT_A_CLEAN.replace("fact_a_clean AS", "fact_a_all AS", 1),
    f"fact_a_clean AS (SELECT * FROM fact_a_all WHERE ({_KEYWORD_HIT}) "
    f"AND length(concat_ws(' ', {', '.join(FACT_TEXT)})) >= {BRIEF})"]).rstrip()
_W_CHAIN = _W_ROWS + ",\n" + ",\n".join([
    f"fact_b_kept AS (SELECT * FROM fact_b WHERE {_sql_kw('x_description')} AND length(x_description) >= {BRIEF})",
    SQL_B_REPAIRED.replace("FROM fact_b\n", "FROM fact_b_kept\n"), SQL_MAPPING_CLEAN, SQL_B_SPLIT, SQL_B_AGG,
    SQL_A_AGG, SQL_MERGED, SQL_PANEL, _M2_SQL, _NOW_SQL, SQL_DEFL, SQL_MODELLED, SQL_NAMES_LU, f"""stacked AS (
  SELECT {RECIPIENT}, year, {MEASURE} AS v FROM fact_a_clean
  UNION ALL SELECT {RECIPIENT}, year, v FROM modelled)"""])


@register("keyword_year", ("T1", "T8", "J10", "P9", "M2", "M4", "G2", "A1"), _W_CHAIN + f"""
SELECT year, round(sum({MEASURE}), 4) AS {MEASURE}, CAST(NULL AS DOUBLE) AS {LWR}, CAST(NULL AS DOUBLE) AS {UPR}
FROM fact_a_clean GROUP BY year
UNION ALL
SELECT year, round(sum(v), 4), round(sum(lo), 4), round(sum(hi), 4) FROM modelled GROUP BY year""")
def keyword_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept actual values per year, and the modelled year with its band."""
    t = tables(spark, sf_dir)
    act = rollups.sum_by(keyword_a(t), ["year"], {MEASURE: MEASURE})
    mod = rollups.sum_by(keyword_modelled(t), ["year"], {MEASURE: "v", LWR: "lo", UPR: "hi"})
    return rollups.union_fill(act, mod).select("year", *[r4(c).alias(c) for c in (MEASURE, LWR, UPR)])


@register("keyword_by_donor", ("T1", "P9", "A1", "O1"), _W_ROWS + f"""
SELECT donor_name, round(sum({MEASURE}), 4) AS {MEASURE} FROM fact_a_clean GROUP BY donor_name""")
def keyword_by_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept actual values per donor, largest first."""
    out = rollups.sum_by(keyword_a(tables(spark, sf_dir)), ["donor_name"], {MEASURE: MEASURE})
    return rollups.order_desc(out.select("donor_name", r4(MEASURE).alias(MEASURE)), MEASURE, ["donor_name"])


@register("keyword_by_recipient", ("T1", "P9", "G2", "J1", "A5", "O1"), _W_CHAIN + f"""
SELECT l.recipient_name, round(sum(s.v), 4) AS {MEASURE}
FROM stacked s LEFT JOIN names_lu l ON s.{RECIPIENT} = l.{RECIPIENT} GROUP BY l.recipient_name""")
def keyword_by_recipient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept actual values and the modelled year per recipient name, largest first."""
    t = tables(spark, sf_dir)
    per = rollups.sum_by(stacked(t, RECIPIENT), [RECIPIENT], {"v": "v"})
    out = rollups.sum_by(lookup_left(per, recipient_name_lookup(t), RECIPIENT), ["recipient_name"], {MEASURE: "v"})
    return rollups.order_desc(out.select("recipient_name", r4(MEASURE).alias(MEASURE)), MEASURE, ["recipient_name"])


_SQL_PLACED = f""",
counted AS (SELECT {RECIPIENT} AS r, year, {GROUP} AS g, count(*) AS n FROM fact_a_all
            WHERE {RECIPIENT} IS NOT NULL AND year IS NOT NULL AND {GROUP} IS NOT NULL GROUP BY ALL),
yearly AS (SELECT r, year, first(g ORDER BY n DESC, g) AS g FROM counted GROUP BY r, year),
totals AS (SELECT {RECIPIENT} AS r, year, sum(v) AS v FROM stacked GROUP BY ALL),
placed AS (SELECT t.r, t.year, t.v, coalesce((SELECT max_by(y.g, y.year) FROM yearly y WHERE y.r = t.r AND y.year <= t.year),
                                             'Unknown') AS g FROM totals t)"""


def placed(t: Tables) -> DataFrame:
    """Totals per recipient and year with the income group of that year; the groups come from all of fact A."""
    totals = rollups.sum_by(stacked(t, RECIPIENT, "year"), [RECIPIENT, "year"], {"v": "v"})
    return validity.as_of(totals, validity.history(fact_a_clean(t), RECIPIENT, "year", GROUP), RECIPIENT, "year", GROUP)


@register("keyword_by_income", ("T1", "P9", "J3", "A2", "A5"), _W_CHAIN + _SQL_PLACED + f"""
SELECT g AS {GROUP}, round(sum(v), 4) AS {MEASURE} FROM placed GROUP BY g""")
def keyword_by_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept actual values and the modelled year per income group, recipients without one as ``Unknown``."""
    out = rollups.sum_by(placed(tables(spark, sf_dir)), [GROUP], {MEASURE: "v"})
    return out.select(GROUP, r4(MEASURE).alias(MEASURE))


@register("keyword_quantiles", ("T1", "P9", "A10", "G2", "A5"), _W_CHAIN + f""",
per AS (SELECT {RECIPIENT}, sum(v) AS v FROM stacked GROUP BY 1),
q AS (SELECT quantile_cont(v, [{", ".join(str(p) for p in _QS)}]) AS q FROM per)
SELECT {", ".join(f"round(q[{i + 1}], 4) AS q{int(round(p * 100)):03d}" for i, p in enumerate(_QS))} FROM q""")
def keyword_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of recipients' totals of kept and modelled values."""
    per = rollups.sum_by(stacked(tables(spark, sf_dir), RECIPIENT), [RECIPIENT], {"v": "v"})
    q = rollups.exact_quantiles(per, "v", _QS)
    return q.select(*[r4(c).alias(c) for c in q.columns])


@register("keyword_totals_agree", ("T1", "P9", "Q2", "A11"), _W_CHAIN + _SQL_PLACED + f"""
SELECT (SELECT round(sum({MEASURE}), 4) FROM fact_a_clean) AS by_donor,
       (SELECT round(sum({MEASURE}), 4) FROM fact_a_clean) AS by_year,
       (SELECT round(sum(v), 4) FROM stacked) AS by_recipient, (SELECT round(sum(v), 4) FROM placed) AS by_income""")
def keyword_totals_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the reports: donors as actual years, income groups as recipients."""
    t = tables(spark, sf_dir)

    def total(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return rollups.sum_by(rows, [key], {"s": value}).agg(r4(rollups.zero_sum("s")).alias(name))

    out = total(keyword_a(t), "donor_name", MEASURE, "by_donor")
    for other in (total(keyword_a(t), "year", MEASURE, "by_year"),
                  total(stacked(t, RECIPIENT), RECIPIENT, "v", "by_recipient"),
                  total(placed(t), GROUP, "v", "by_income")):
        out = attach_scalars(out, other)
    return out


# ------------------------------------------------- comparison with the modelled year

_PURPOSES = ", ".join(f"'{p}'" for p in SECTOR_DEFINITION)
_SIDES = {"v": MEASURE, "lo": LWR, "hi": UPR}
_COLS = [f"{m}_{s}" for s in ("purpose", "keyword") for m in _SIDES.values()]
_COUNTRY = "".join(f" AND NOT ends_with(l.recipient_name, '{s}')" for s in SUFFIXES)


def _sql_side(actual: str, model: str) -> str:
    return f"""SELECT s.{RECIPIENT} AS iso_3, sum(s.v) AS v, sum(s.lo) AS lo, sum(s.hi) AS hi
FROM (SELECT {RECIPIENT}, {MEASURE} AS v, {MEASURE} AS lo, {MEASURE} AS hi FROM fact_a_clean{actual}
      UNION ALL SELECT {RECIPIENT}, v, lo, hi FROM {model}) s
JOIN names_lu l ON s.{RECIPIENT} = l.{RECIPIENT}
WHERE s.{RECIPIENT} <> '{UNSPECIFIED_ISO}'{_COUNTRY} GROUP BY 1"""


_W_SECTOR = SQL_FE_NOW.rstrip() + ",\n" + SQL_DEFL + f""",
names_lu AS (SELECT iso3 AS {RECIPIENT}, recipient_name FROM nation_codes
             UNION SELECT recipient_iso3_code, recipient_name FROM region_mapping),
sector_modelled AS (
  SELECT {RECIPIENT}, greatest(fit * f, 0) AS v, greatest(lwr * f, 0) AS lo, greatest(upr * f, 0) AS hi
  FROM fe_now, defl WHERE sector_code IN ({_PURPOSES}))
"""


def _side(t: Tables, actual: DataFrame, model: DataFrame) -> DataFrame:
    """Per country: actual values, whose band is the value (P22), and the modelled year with its band."""
    rows = actual.select(RECIPIENT, *[F.col(MEASURE).alias(c) for c in _SIDES]).unionByName(
        model.select(RECIPIENT, *_SIDES))
    per = rollups.sum_by(rows, [RECIPIENT], {m: c for c, m in _SIDES.items()})
    named = lookup_left(per, recipient_name_lookup(t), RECIPIENT)
    return (named.filter(C.ends_with_none("recipient_name", SUFFIXES) & (F.col(RECIPIENT) != UNSPECIFIED_ISO))
            .select(F.col(RECIPIENT).alias("iso_3"), *_SIDES.values()))


@register("definition_comparison_modelled", ("P22", "A3", "G2", "J6", "P6", "T1", "M3", "M4"), f"""
SELECT coalesce(p.iso_3, k.iso_3) AS iso_3,
       {", ".join(f"round(coalesce({s[0]}.{c}, 0), 4) AS {m}_{s}" for s in ("purpose", "keyword") for c, m in _SIDES.items())}
FROM ({_W_SECTOR} {_sql_side(f" WHERE purpose_code IN ({_PURPOSES})", "sector_modelled")}) p
FULL OUTER JOIN ({_W_CHAIN} {_sql_side("", "modelled")}) k ON p.iso_3 = k.iso_3""")
def definition_comparison_modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per country: sector and keyword definition with the modelled year and its band, regions left out."""
    t = tables(spark, sf_dir)
    chosen = F.col("purpose_code").isin(*SECTOR_DEFINITION)
    model = deflated(t, fe_nowcast(t).filter(F.col("sector_code").isin(*SECTOR_DEFINITION)), RECIPIENT)
    purpose = _side(t, fact_a_clean(t).filter(chosen), model)
    keyword = _side(t, keyword_a(t), keyword_modelled(t))
    j = joins.full_with_suffixes(purpose, keyword, "iso_3", ("_purpose", "_keyword"), fill=0.0)
    return j.select("iso_3", *[r4(c).alias(c) for c in _COLS])


@register("sector_year_purpose", ("A2", "A9", "G2", "M3", "P11", "P10"), _W_SECTOR + f""",
rows_ AS (SELECT year, purpose_code, {MEASURE} AS v FROM fact_a_clean WHERE purpose_code IN ({_PURPOSES})
          UNION ALL SELECT n.year, n.sector_code, greatest(n.fit * d.f, 0) FROM fe_now n, defl d
          WHERE n.sector_code IN ({_PURPOSES}))
SELECT year, {", ".join(f"round(coalesce(sum(v) FILTER (purpose_code = '{p}'), 0), 4) AS {p.lower()}" for p in SECTOR_DEFINITION)}
FROM rows_ GROUP BY year""")
def sector_year_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector definition: a column per purpose, the modelled year below the actual ones."""
    t = tables(spark, sf_dir)
    act = fact_a_clean(t).select("year", "purpose_code", F.col(MEASURE).alias("v"))
    mod = deflated(t, fe_nowcast(t), "sector_code", "year").select("year", F.col("sector_code").alias("purpose_code"), "v")
    rows = act.unionByName(mod).filter(F.col("purpose_code").isin(*SECTOR_DEFINITION))
    return rows.groupBy("year").agg(*[r4(rollups.zero_sum(F.when(F.col("purpose_code") == p, F.col("v")))).alias(p.lower())
                                      for p in SECTOR_DEFINITION])
