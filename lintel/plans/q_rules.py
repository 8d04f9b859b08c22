"""Step 2: predicates and scalar rules (P-series) on the two facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import columns as C
from lintel.operators import rollups
from lintel.plans.common import (PUBLISHER_RULES, REPAIR_RULES, SQL_FACT_A_CLEAN, SQL_HSPACE, SQL_SPACE,
                                 fact_a_clean, r4, tables)
from lintel.plans.oracle_views import with_views
from lintel.plans.registry import register
from lintel.sources import views

W_A = with_views("fact_a", extra=[SQL_FACT_A_CLEAN])
W_B = with_views("fact_b")
MEASURE = "usd_disbursement_deflated"


@register("excluded_rows_kept_nulls", ("P3", "A7"), W_A + """
SELECT aid_type, count(*) AS n FROM fact_a_clean GROUP BY aid_type""")
def excluded_rows_kept_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per aid type after the null-safe exclusion: NULL and 'NA' stay."""
    return rollups.frequency(fact_a_clean(tables(spark, sf_dir)), ["aid_type"])


@register("key_and_text_predicates", ("P4", "P5", "P7"), W_B + """
SELECT x_transaction_year, count(*) AS n,
       round(coalesce(sum(x_transaction_value_usd), 0) / 1e6, 4) AS usd_m
FROM fact_b
WHERE reporting_org_ref IS NOT NULL
  AND NOT starts_with(x_sector_code, 'PRO')
  AND contains(funding_orgs, '(1-URGENT)')
GROUP BY x_transaction_year""")
def key_and_text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fb = views.fact_b_table(tables(spark, sf_dir))
    f = (fb.filter(F.col("reporting_org_ref").isNotNull())
         .filter(C.starts_with("x_sector_code", "PRO", negate=True))
         .filter(C.contains_literal("funding_orgs", "(1-URGENT)")))
    return (f.groupBy("x_transaction_year")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 r4(rollups.zero_sum("x_transaction_value_usd") / 1e6).alias("usd_m")))


@register("conditional_publisher_filter", ("P8",), W_B + """
SELECT reporting_org_ref, count(*) AS n FROM fact_b
WHERE reporting_org_ref IS NOT NULL
  AND (reporting_org_ref <> 'P0' OR coalesce(contains(funding_orgs, 'URGENT'), false))
  AND (reporting_org_ref <> 'P1' OR coalesce(contains(funding_orgs, '(2-HIGH)'), false))
GROUP BY reporting_org_ref""")
def conditional_publisher_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fb = views.fact_b_table(tables(spark, sf_dir))
    return rollups.frequency(fb.filter(C.conditional_keep("reporting_org_ref", "funding_orgs", PUBLISHER_RULES)),
                             ["reporting_org_ref"])


_REPAIR_SQL = " ".join(f"WHEN starts_with(iati_identifier, '{p}') THEN '{v}'" for p, v in reversed(REPAIR_RULES))


@register("repair_and_trim_keys", ("P13", "P14"), W_B + rf"""
SELECT regexp_replace(CASE {_REPAIR_SQL} ELSE reporting_org_ref END,
                      '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') AS reporting_org_ref,
       count(*) AS n
FROM fact_b GROUP BY 1""")
def repair_and_trim_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    fb = views.fact_b_table(tables(spark, sf_dir))
    key = C.unicode_trim(C.repair_from_prefix("reporting_org_ref", "iati_identifier", REPAIR_RULES))
    return rollups.frequency(fb.withColumn("reporting_org_ref", key), ["reporting_org_ref"])


@register("normalized_donor_names", ("P15", "J1"), with_views("fact_a", "publisher_map") + rf""",
a_names AS (SELECT DISTINCT donor_name FROM fact_a)
SELECT m.reporting_org_ref, m.donor_code,
       regexp_replace(m.donor_name, '{SQL_HSPACE}', ' ', 'g') AS donor_name,
       a.donor_name IS NOT NULL AS in_fact_a
FROM publisher_map m
LEFT JOIN a_names a ON regexp_replace(m.donor_name, '{SQL_HSPACE}', ' ', 'g') = a.donor_name""")
def normalized_donor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping names with horizontal spaces made plain, checked against the
    donor names that fact A uses."""
    t = tables(spark, sf_dir)
    m = views.publisher_map(t).withColumn("donor_name", C.hspace_to_space("donor_name"))
    a_names = views.fact_a_table(t).select("donor_name").distinct().withColumn("_hit", F.lit(True))
    j = m.join(a_names, "donor_name", "left")
    return j.select("reporting_org_ref", "donor_code", "donor_name",
                    F.coalesce("_hit", F.lit(False)).alias("in_fact_a"))


SUFFIXES = (", regional", ", unspecified")


@register("name_suffix_filter", ("P6", "A1"), W_A + f"""
SELECT recipient_name, round(coalesce(sum({MEASURE}), 0), 4) AS {MEASURE}
FROM fact_a_clean
WHERE NOT ends_with(recipient_name, ', regional') AND NOT ends_with(recipient_name, ', unspecified')
GROUP BY recipient_name""")
def name_suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fa = fact_a_clean(tables(spark, sf_dir)).filter(C.ends_with_none("recipient_name", SUFFIXES))
    out = rollups.sum_by(fa, ["recipient_name"], {MEASURE: MEASURE})
    return out.select("recipient_name", r4(MEASURE).alias(MEASURE))


# Short display names for a few donors (single-value renames, P12).
SHORT_NAMES = {"NATION 0": "N-0", "NATION 1": "N-1", "NATION 2": "N-2", "NATION 3": "N-3"}


@register("recode_short_names", ("P12", "A1", "O1"), W_A + f""",
tot AS (SELECT donor_name, coalesce(sum({MEASURE}), 0) AS v FROM fact_a_clean GROUP BY donor_name)
SELECT CASE donor_name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHORT_NAMES.items())}
            ELSE donor_name END AS donor_name,
       round(v, 4) AS {MEASURE}
FROM tot""")
def recode_short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    fa = fact_a_clean(tables(spark, sf_dir))
    out = rollups.sum_by(fa, ["donor_name"], {MEASURE: MEASURE})
    out = out.select(C.recode("donor_name", SHORT_NAMES).alias("donor_name"), r4(MEASURE).alias(MEASURE))
    return rollups.order_desc(out, MEASURE, ["donor_name"])


BIN_EDGES = (0, 1, 10, 50, 100, 500, 1000, 1500)


def _bin_sql(v: str) -> tuple[str, str]:
    n = len(BIN_EDGES) - 1
    idx, lab = [], []
    for i in range(n):
        lo, hi = BIN_EDGES[i], BIN_EDGES[i + 1]
        op = "<=" if i == n - 1 else "<"
        idx.append(f"WHEN {v} >= {lo} AND {v} {op} {hi} THEN {i}")
        lab.append(f"WHEN {v} >= {lo} AND {v} {op} {hi} THEN '{lo} - {hi}'")
    return "CASE " + " ".join(idx) + " END", "CASE " + " ".join(lab) + " END"


_BIN_IDX, _BIN_LAB = _bin_sql("v")


@register("value_bins", ("P20", "A1"), W_A + f""",
tot AS (SELECT recipient_iso3_code, coalesce(sum({MEASURE}), 0) AS v FROM fact_a_clean GROUP BY 1)
SELECT recipient_iso3_code, round(v, 4) AS {MEASURE},
       CAST({_BIN_IDX} AS INTEGER) AS bin, {_BIN_LAB} AS bin_label
FROM tot""")
def value_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    fa = fact_a_clean(tables(spark, sf_dir))
    tot = rollups.sum_by(fa, ["recipient_iso3_code"], {"v": MEASURE})
    return tot.select("recipient_iso3_code", r4("v").alias(MEASURE),
                      C.value_bin("v", BIN_EDGES).alias("bin"), C.bin_label("v", BIN_EDGES).alias("bin_label"))
