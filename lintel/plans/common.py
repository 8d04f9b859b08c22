"""Shared building blocks for the registered queries (Spark and SQL sides)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions.columns import oda_exclusion
from lintel.sources import views
from lintel.sources.tables import Tables

# Fixed values of the stand-in domain ------------------------------------
# Excluded codes of the exclusion predicate (as in the reference: sector 930,
# aid types E01 and E02).
EXCLUDED_SECTORS = ("930",)
EXCLUDED_AID_TYPES = ("E01", "E02")
# The six purpose codes of the stand-in fact (part types), pivot columns.
PURPOSES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
# The "sector definition" of the stand-in: two purpose codes, like the
# reference's two housing purpose codes.
SECTOR_DEFINITION = ("LARGE", "MEDIUM")
# Publisher rules for the conditional filter (P8): publisher → required text.
PUBLISHER_RULES = (("P0", "URGENT"), ("P1", "(2-HIGH)"))
# Key repair rules (P13): identifier prefix → publisher.
REPAIR_RULES = (("P5-", "P5"), ("P6-", "P6"))
# Code override of the ISO lookup (J9), as in the reference.
ISO_OVERRIDES = (("XK", "XKV"),)
# Deflator sheet stand-in (S4): (row name, year, deflator).
DEFLATORS = (("TOTAL DAC", 2001, 1.0335), ("OTHER", 2001, 0.9),)
# Nowcast year of fact B and the last year of fact A.
NOWCAST_YEAR = 2001
LAST_ACTUAL_YEAR = 2000


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def fact_a_clean(t: Tables) -> DataFrame:
    """Fact A after the exclusion predicate (P3), blanks kept."""
    return views.fact_a_table(t).filter(oda_exclusion("sector_code", "aid_type",
                                                EXCLUDED_SECTORS, EXCLUDED_AID_TYPES))


SQL_EXCLUSION = ("NOT (sector_code IS NOT DISTINCT FROM '930') "
                 "AND NOT (aid_type IS NOT DISTINCT FROM 'E01') "
                 "AND NOT (aid_type IS NOT DISTINCT FROM 'E02')")

SQL_FACT_A_CLEAN = f"fact_a_clean AS (SELECT * FROM fact_a WHERE {SQL_EXCLUSION})"


def r4(c):
    return F.round(c, 4)


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------- fact B chain
# Spark side and SQL side of: key repair → trim → split over the publisher
# map → conditional publisher filter → drop unmapped → names normalised →
# aggregate → recipient code resolution.

def b_repaired(t: Tables, fact: DataFrame | None = None) -> DataFrame:
    """P13 + P14 on the publisher key of fact B, or of the rows of it in ``fact``."""
    from lintel.functions.columns import repair_from_prefix, unicode_trim
    fb = views.fact_b_table(t) if fact is None else fact
    return fb.withColumn("reporting_org_ref",
                         unicode_trim(repair_from_prefix("reporting_org_ref", "iati_identifier", REPAIR_RULES)))


def mapping_clean(t: Tables) -> DataFrame:
    """Publisher map without unmapped rows, donor names with plain spaces."""
    from lintel.functions.columns import hspace_to_space
    return (views.publisher_map(t).filter(F.col("donor_code").isNotNull())
            .withColumn("donor_name", hspace_to_space("donor_name")))


def b_split(t: Tables, fact: DataFrame | None = None) -> DataFrame:
    """J4 split, then P8 and the unmapped-row drop (after the split)."""
    from lintel.functions.columns import conditional_keep
    from lintel.operators.joins import split_values
    s = split_values(b_repaired(t, fact), mapping_clean(t), "reporting_org_ref", ["x_transaction_value_usd"])
    return (s.filter(conditional_keep("reporting_org_ref", "funding_orgs", PUBLISHER_RULES))
            .filter(F.col("donor_code").isNotNull()))


def b_agg(t: Tables) -> DataFrame:
    """Fact B summed per (donor, year, recipient, sector) in US$ millions,
    recipient codes resolved to ISO-3 (region mapping, override, ISO table);
    unresolved codes dropped.  Written once as an intermediate table (the
    aggregate is dimension-sized and read by several reports)."""
    from lintel.sources.warehouse import materialized
    return materialized(t, "b_agg", _b_agg)


def _b_agg(t: Tables, fact: DataFrame | None = None) -> DataFrame:
    from lintel.operators.joins import recode_via_lookups
    from lintel.operators.rollups import sum_by
    s = b_split(t, fact).withColumn("v", F.col("x_transaction_value_usd") / 1e6)
    agg = sum_by(s, ["donor_code", "donor_name", "x_transaction_year", "x_recipient_code", "x_sector_code"],
                 {"usd_disbursement_iati": "v"})
    spark = t.spark
    overrides = spark.createDataFrame(list(ISO_OVERRIDES), "code string, iso3 string")
    layers = [(views.region_mapping(t), "recipient_code", "recipient_iso3_code"),
              (overrides, "code", "iso3"),
              (views.iso_table(t), "iso2", "iso3")]
    res = recode_via_lookups(agg, "x_recipient_code", "recipient_iso3_code", layers)
    res = sum_by(res, ["donor_code", "donor_name", "x_transaction_year", "recipient_iso3_code", "x_sector_code"],
                 {"usd_disbursement_iati": "usd_disbursement_iati"})
    return res.select("donor_code", "donor_name", F.col("x_transaction_year").alias("year"),
                      "recipient_iso3_code", F.col("x_sector_code").alias("sector_code"),
                      "usd_disbursement_iati")


def a_agg(t: Tables, fact: DataFrame | None = None) -> DataFrame:
    """Fact A summed per (donor, year, recipient, sector=purpose code)."""
    from lintel.operators.rollups import sum_by
    fa = (fact_a_clean(t) if fact is None else fact).withColumn("sector_code", F.col("purpose_code"))
    return sum_by(fa, ["donor_code", "donor_name", "year", "recipient_iso3_code", "sector_code"],
                  {"usd_disbursement_crs": "usd_disbursement"})


RECONCILE_KEYS = ["donor_code", "donor_name", "year", "recipient_iso3_code", "sector_code"]


def merged_panel(t: Tables) -> DataFrame:
    """A and B aggregates reconciled on all five keys (NULL-safe).

    Written once as an intermediate table: every model and panel starts
    from it, and it is small (one row per donor, year, recipient, sector)."""
    from lintel.sources.warehouse import materialized
    return materialized(t, "merged", _merged)


def _merged(t: Tables) -> DataFrame:
    from lintel.operators.joins import full_reconcile
    return full_reconcile(a_agg(t), b_agg(t), RECONCILE_KEYS)


# SQL twins ------------------------------------------------------------------
SQL_SPACE = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
SQL_HSPACE = r"[\t \x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"

SQL_B_REPAIRED = rf"""b_repaired AS (
  SELECT * REPLACE (
    regexp_replace(
      CASE WHEN starts_with(iati_identifier, 'P6-') THEN 'P6'
           WHEN starts_with(iati_identifier, 'P5-') THEN 'P5'
           ELSE reporting_org_ref END,
      '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') AS reporting_org_ref)
  FROM fact_b
)"""

SQL_MAPPING_CLEAN = rf"""mapping_clean AS (
  SELECT reporting_org_ref, donor_code,
         regexp_replace(donor_name, '{SQL_HSPACE}', ' ', 'g') AS donor_name,
         1.0 / count(*) OVER (PARTITION BY reporting_org_ref) AS w
  FROM publisher_map WHERE donor_code IS NOT NULL
)"""

SQL_B_SPLIT = """b_split AS (
  SELECT b.* REPLACE (b.x_transaction_value_usd * coalesce(m.w, 1.0) AS x_transaction_value_usd),
         m.donor_code, m.donor_name
  FROM b_repaired b LEFT JOIN mapping_clean m ON b.reporting_org_ref = m.reporting_org_ref
  WHERE b.reporting_org_ref IS NOT NULL
    AND (b.reporting_org_ref <> 'P0' OR coalesce(contains(b.funding_orgs, 'URGENT'), false))
    AND (b.reporting_org_ref <> 'P1' OR coalesce(contains(b.funding_orgs, '(2-HIGH)'), false))
    AND m.donor_code IS NOT NULL
)"""

SQL_B_AGG = """b_agg0 AS (
  SELECT donor_code, donor_name, x_transaction_year, x_recipient_code, x_sector_code,
         coalesce(sum(x_transaction_value_usd / 1e6), 0) AS usd_disbursement_iati
  FROM b_split GROUP BY ALL
),
region_lu AS (SELECT recipient_code AS k, min(recipient_iso3_code) AS v FROM region_mapping GROUP BY 1),
iso_lu AS (SELECT iso2 AS k, min(iso3) AS v FROM iso_table GROUP BY 1),
b_agg AS (
  SELECT a.donor_code, a.donor_name, a.x_transaction_year AS year,
         coalesce(r.v, CASE WHEN a.x_recipient_code = 'XK' THEN 'XKV' END, i.v) AS recipient_iso3_code,
         a.x_sector_code AS sector_code,
         coalesce(sum(a.usd_disbursement_iati), 0) AS usd_disbursement_iati
  FROM b_agg0 a LEFT JOIN region_lu r ON a.x_recipient_code = r.k
  LEFT JOIN iso_lu i ON a.x_recipient_code = i.k
  WHERE coalesce(r.v, CASE WHEN a.x_recipient_code = 'XK' THEN 'XKV' END, i.v) IS NOT NULL
  GROUP BY ALL
)"""

SQL_A_AGG = """a_agg AS (
  SELECT donor_code, donor_name, year, recipient_iso3_code, purpose_code AS sector_code,
         coalesce(sum(usd_disbursement), 0) AS usd_disbursement_crs
  FROM fact_a_clean GROUP BY ALL
)"""

SQL_MERGED = """merged AS (
  SELECT coalesce(a.donor_code, b.donor_code) AS donor_code,
         coalesce(a.donor_name, b.donor_name) AS donor_name,
         coalesce(a.year, b.year) AS year,
         coalesce(a.recipient_iso3_code, b.recipient_iso3_code) AS recipient_iso3_code,
         coalesce(a.sector_code, b.sector_code) AS sector_code,
         a.usd_disbursement_crs, b.usd_disbursement_iati
  FROM a_agg a FULL OUTER JOIN b_agg b
    ON a.donor_code IS NOT DISTINCT FROM b.donor_code
   AND a.donor_name IS NOT DISTINCT FROM b.donor_name
   AND a.year IS NOT DISTINCT FROM b.year
   AND a.recipient_iso3_code IS NOT DISTINCT FROM b.recipient_iso3_code
   AND a.sector_code IS NOT DISTINCT FROM b.sector_code
)"""

B_CHAIN_SQL = [SQL_B_REPAIRED, SQL_MAPPING_CLEAN, SQL_B_SPLIT, SQL_B_AGG]
