"""Step 3: value splitting, reconciliation, code resolution and name checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators import checks, rollups
from lintel.operators.joins import dedupe_lookup, lookup_left, recode_via_lookups, split_values
from lintel.plans.common import (B_CHAIN_SQL, ISO_OVERRIDES, SQL_A_AGG, SQL_B_REPAIRED, SQL_FACT_A_CLEAN,
                                 SQL_MAPPING_CLEAN, SQL_MERGED, a_agg, b_agg, b_repaired, fact_a_clean,
                                 mapping_clean, merged_panel, r4, tables)
from lintel.plans.oracle_views import with_views
from lintel.plans.registry import register
from lintel.sources import views

W_B_CHAIN = with_views("fact_b", "publisher_map", "region_mapping", "iso_table")


@register("split_publisher_values", ("J4", "W3", "A7"),
          W_B_CHAIN.rstrip() + ",\n" + ",\n".join([SQL_B_REPAIRED, SQL_MAPPING_CLEAN]) + """
SELECT m.donor_code, count(*) AS n,
       round(coalesce(sum(b.x_transaction_value_usd * coalesce(m.w, 1.0)), 0) / 1e6, 4) AS usd_m
FROM b_repaired b LEFT JOIN mapping_clean m ON b.reporting_org_ref = m.reporting_org_ref
GROUP BY m.donor_code""")
def split_publisher_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each publisher row fans out to its k donors with value × 1/k; rows of
    unmapped publishers keep one row (donor NULL) and their full value."""
    t = tables(spark, sf_dir)
    s = split_values(b_repaired(t), mapping_clean(t), "reporting_org_ref", ["x_transaction_value_usd"])
    return (s.groupBy("donor_code")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 r4(rollups.zero_sum("x_transaction_value_usd") / 1e6).alias("usd_m")))


@register("split_conserves_total", ("Q2", "A11"),
          W_B_CHAIN.rstrip() + ",\n" + ",\n".join([SQL_B_REPAIRED, SQL_MAPPING_CLEAN]) + """,
pre AS (SELECT coalesce(sum(x_transaction_value_usd), 0) AS s FROM b_repaired),
post AS (SELECT coalesce(sum(b.x_transaction_value_usd * coalesce(m.w, 1.0)), 0) AS s
         FROM b_repaired b LEFT JOIN mapping_clean m ON b.reporting_org_ref = m.reporting_org_ref)
SELECT round(pre.s / 1e6, 4) AS pre_total, round(post.s / 1e6, 4) AS post_total,
       abs(pre.s - post.s) <= 1e-7 * abs(pre.s) AS conserved
FROM pre, post""")
def split_conserves_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    before = b_repaired(t)
    after = split_values(before, mapping_clean(t), "reporting_org_ref", ["x_transaction_value_usd"])
    return checks.totals_conserved(before, after, "x_transaction_value_usd", scale=1e-6, digits=4)


_MERGED_WITH = (with_views("fact_a", "fact_b", "publisher_map", "region_mapping", "iso_table",
                           extra=[SQL_FACT_A_CLEAN] + B_CHAIN_SQL + [SQL_A_AGG, SQL_MERGED]))


@register("reconcile_a_b", ("A2", "J9", "J5"), _MERGED_WITH + """
SELECT donor_code, donor_name, year, recipient_iso3_code, sector_code,
       round(usd_disbursement_crs, 4) AS usd_disbursement_crs,
       round(usd_disbursement_iati, 4) AS usd_disbursement_iati
FROM merged""")
def reconcile_a_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merged_panel(tables(spark, sf_dir))
    return m.select("donor_code", "donor_name", "year", "recipient_iso3_code", "sector_code",
                    r4("usd_disbursement_crs").alias("usd_disbursement_crs"),
                    r4("usd_disbursement_iati").alias("usd_disbursement_iati"))


@register("unresolved_keys", ("Q1", "J9", "P4"), with_views("fact_b", "region_mapping", "iso_table") + """
SELECT x_recipient_code, count(*) AS n
FROM fact_b b
WHERE NOT EXISTS (SELECT 1 FROM region_mapping r WHERE r.recipient_code = b.x_recipient_code)
  AND x_recipient_code IS DISTINCT FROM 'XK'
  AND NOT EXISTS (SELECT 1 FROM iso_table i WHERE i.iso2 = b.x_recipient_code)
GROUP BY x_recipient_code""")
def unresolved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipient codes of fact B that no lookup layer resolves (and how many
    rows carry them); the resolution step drops exactly these rows."""
    t = tables(spark, sf_dir)
    overrides = spark.createDataFrame(list(ISO_OVERRIDES), "code string, iso3 string")
    layers = [(views.region_mapping(t), "recipient_code", "recipient_iso3_code"),
              (overrides, "code", "iso3"), (views.iso_table(t), "iso2", "iso3")]
    res = recode_via_lookups(views.fact_b_table(t), "x_recipient_code", "_iso3", layers, drop_unresolved=False)
    return rollups.frequency(res.filter(F.col("_iso3").isNull()), ["x_recipient_code"])


_NAMES_WITH = (with_views("fact_a", "fact_b", "publisher_map", "region_mapping", "iso_table",
                          "recipient_names", extra=[SQL_FACT_A_CLEAN] + B_CHAIN_SQL))
_NAMES_LU = """names_lu AS (SELECT recipient_iso3_code, min(recipient_name) AS recipient_name
                  FROM recipient_names GROUP BY 1)"""


@register("one_sided_names", ("G3", "Q3", "J1"), _NAMES_WITH.rstrip() + ",\n" + _NAMES_LU + """,
a AS (SELECT DISTINCT recipient_name FROM fact_a_clean WHERE recipient_name IS NOT NULL),
b AS (SELECT DISTINCT n.recipient_name FROM b_agg x LEFT JOIN names_lu n
        ON x.recipient_iso3_code = n.recipient_iso3_code WHERE n.recipient_name IS NOT NULL)
SELECT recipient_name, 'a_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL
SELECT recipient_name, 'b_only' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def one_sided_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    names = dedupe_lookup(views.recipient_names(t), "recipient_iso3_code")
    a = fact_a_clean(t).select("recipient_name")
    b = lookup_left(b_agg(t), names, "recipient_iso3_code").select("recipient_name")
    return rollups.one_sided(a, b, "recipient_name", ("a_only", "b_only"))


@register("named_recipients", ("G1", "J1", "A1"), _NAMES_WITH.rstrip() + ",\n" + _NAMES_LU + """
SELECT n.recipient_name, round(coalesce(sum(x.usd_disbursement_iati), 0), 4) AS usd_disbursement_iati
FROM b_agg x LEFT JOIN names_lu n ON x.recipient_iso3_code = n.recipient_iso3_code
GROUP BY n.recipient_name""")
def named_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B totals by recipient name; the name table (countries ∪ regions) is
    deduplicated on its key first, so a doubled region code cannot double
    its value (D1)."""
    t = tables(spark, sf_dir)
    names = dedupe_lookup(views.recipient_names(t), "recipient_iso3_code")
    j = lookup_left(b_agg(t), names, "recipient_iso3_code")
    out = rollups.sum_by(j, ["recipient_name"], {"usd_disbursement_iati": "usd_disbursement_iati"})
    return out.select("recipient_name", r4("usd_disbursement_iati").alias("usd_disbursement_iati"))


__all__ = ["a_agg"]
