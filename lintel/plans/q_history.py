"""Income groups with validity, over actual years and the year that only fact B reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators import rollups, validity
from lintel.operators.joins import attach_scalars
from lintel.plans.common import (B_CHAIN_SQL, NOWCAST_YEAR, SQL_A_AGG, SQL_FACT_A_CLEAN, SQL_MERGED, fact_a_clean,
                                 merged_panel, r4, tables)
from lintel.plans.oracle_views import with_views
from lintel.plans.registry import register

GROUP = "income_group_name"
RECIPIENT = "recipient_iso3_code"

_SQL = with_views("fact_a", "fact_b", "publisher_map", "region_mapping", "iso_table",
                  extra=[SQL_FACT_A_CLEAN] + B_CHAIN_SQL + [SQL_A_AGG, SQL_MERGED]) + f""",
counted AS (SELECT {RECIPIENT} AS r, year, {GROUP} AS g, count(*) AS n FROM fact_a_clean
            WHERE {RECIPIENT} IS NOT NULL AND year IS NOT NULL AND {GROUP} IS NOT NULL GROUP BY ALL),
yearly AS (SELECT r, year, first(g ORDER BY n DESC, g) AS g FROM counted GROUP BY r, year),
totals AS (SELECT {RECIPIENT} AS r, year,
                  coalesce(sum(CASE WHEN year = {NOWCAST_YEAR} THEN usd_disbursement_iati ELSE usd_disbursement_crs END), 0) AS v
           FROM merged GROUP BY ALL),
placed AS (SELECT t.r, t.year, t.v, coalesce((SELECT max_by(y.g, y.year) FROM yearly y WHERE y.r = t.r AND y.year <= t.year),
                                             'Unknown') AS g FROM totals t)
"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per recipient and year (fact A, the last year from fact B) with the income group of that year."""
    t = tables(spark, sf_dir)
    told = F.when(F.col("year") == NOWCAST_YEAR, F.col("usd_disbursement_iati")).otherwise(F.col("usd_disbursement_crs"))
    totals = rollups.sum_by(merged_panel(t).withColumn("_v", told), [RECIPIENT, "year"], {"v": "_v"})
    return validity.as_of(totals, validity.history(fact_a_clean(t), RECIPIENT, "year", GROUP), RECIPIENT, "year", GROUP)


@register("by_income_group_as_of", ("J3", "A2", "A5"), _SQL + f"""
SELECT g AS {GROUP}, year, count(*) AS n_recipients, round(sum(v), 4) AS usd_disbursement FROM placed GROUP BY g, year""")
def by_income_group_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per income group as of the year, latest group kept, recipients without one as ``Unknown``."""
    return _placed(spark, sf_dir).groupBy(GROUP, "year").agg(
        F.count(F.lit(1)).alias("n_recipients"), r4(F.sum("v")).alias("usd_disbursement"))


@register("income_groups_conserve_total", ("J3", "Q2", "A11"), _SQL + """
SELECT round((SELECT sum(v) FROM placed), 4) AS by_income, round((SELECT sum(v) FROM totals), 4) AS by_recipient""")
def income_groups_conserve_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum over income groups next to that over recipients: a recipient that changes its group counts once."""
    t = tables(spark, sf_dir)
    told = F.when(F.col("year") == NOWCAST_YEAR, F.col("usd_disbursement_iati")).otherwise(F.col("usd_disbursement_crs"))
    plain = merged_panel(t).agg(r4(rollups.zero_sum(told)).alias("by_recipient"))
    return attach_scalars(_placed(spark, sf_dir).agg(r4(F.sum("v")).alias("by_income")), plain)
