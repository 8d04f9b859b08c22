"""Steps 0-1: extract, round trip and the roll-up reports of fact A."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.functions.columns import recode
from lintel.operators import rollups
from lintel.operators.joins import lookup_inner
from lintel.plans.common import PURPOSES, SECTOR_DEFINITION, SQL_FACT_A_CLEAN, fact_a_clean, r4, tables
from lintel.plans.oracle_views import with_views
from lintel.plans.registry import register
from lintel.session import scratch_path
from lintel.sources import files, views

W_A = with_views("fact_a", extra=[SQL_FACT_A_CLEAN])
MEASURE = "usd_disbursement_deflated"


def total_by_donor_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    fa = fact_a_clean(tables(spark, sf_dir))
    out = rollups.sum_by(fa, ["donor_name"], {MEASURE: MEASURE})
    return rollups.order_desc(out.select("donor_name", r4(MEASURE).alias(MEASURE)), MEASURE, ["donor_name"])


register("total_by_donor", ("P3", "A1", "O1"), W_A + f"""
SELECT donor_name, round(coalesce(sum({MEASURE}), 0), 4) AS {MEASURE}
FROM fact_a_clean GROUP BY donor_name ORDER BY 2 DESC, 1""")(total_by_donor_df)


@register("warehouse_extract", ("S3", "P1", "P2", "P19"), with_views("fact_a") + """
SELECT row_id, year, CAST(donor_code AS VARCHAR) AS donor_code, recipient_iso3_code,
       purpose_code AS sector_code, usd_disbursement
FROM fact_a
WHERE year BETWEEN 1996 AND 1999 AND purpose_code IN ('LARGE', 'MEDIUM')""")
def warehouse_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    fa = views.fact_a_table(tables(spark, sf_dir))
    return (fa.filter(F.col("year").between(1996, 1999) & F.col("purpose_code").isin(*SECTOR_DEFINITION))
            .select("row_id", "year", F.col("donor_code").cast("string").alias("donor_code"),
                    "recipient_iso3_code", F.col("purpose_code").alias("sector_code"),
                    "usd_disbursement"))


DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@register("csv_round_trip", ("S1", "S2", "S5"), """
SELECT doc_id, text, lang, source, n_chars FROM documents""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document to CSV under the shared scratch folder and read it
    back with the declared schema (multi-line quoted text survives)."""
    t = tables(spark, sf_dir)
    path = scratch_path(spark, "csv_round_trip")
    files.write_table(t.documents.select(*DOC_SCHEMA.fieldNames()), path, fmt="csv")
    return files.read_table(spark, path, DOC_SCHEMA)


@register("total_by_year", ("P3", "A1"), W_A + f"""
SELECT year, round(coalesce(sum({MEASURE}), 0), 4) AS {MEASURE}
FROM fact_a_clean GROUP BY year ORDER BY year""")
def total_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    fa = fact_a_clean(tables(spark, sf_dir))
    out = rollups.sum_by(fa, ["year"], {MEASURE: MEASURE})
    return out.select("year", r4(MEASURE).alias(MEASURE)).orderBy("year")


_PIVOT_SQL = ",\n       ".join(
    f"round(sum({MEASURE}) FILTER (WHERE purpose_code = '{p}'), 4) AS p_{p.lower()}" for p in PURPOSES)


@register("year_purpose_pivot", ("A2", "A9"), W_A + f"""
SELECT year,
       {_PIVOT_SQL}
FROM fact_a_clean GROUP BY year ORDER BY year""")
def year_purpose_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    fa = fact_a_clean(tables(spark, sf_dir))
    out = rollups.pivot_sum(fa, "year", "purpose_code", PURPOSES, MEASURE)
    return out.select("year", *[r4(f"p_{p.lower()}").alias(f"p_{p.lower()}") for p in PURPOSES]).orderBy("year")


# Single-value rename applied to the donor-type lookup before the join.
DONOR_TYPE_RENAMES = {"Nation Three": "NATION 3"}


@register("by_donor_type", ("J2", "P12", "A1", "O1"), with_views("fact_a", "donor_types", extra=[SQL_FACT_A_CLEAN]) + f"""
SELECT dt.donor_type, round(coalesce(sum(f.{MEASURE}), 0), 4) AS {MEASURE}
FROM fact_a_clean f
JOIN (SELECT CASE WHEN donor_name = 'Nation Three' THEN 'NATION 3' ELSE donor_name END AS donor_name,
             donor_type FROM donor_types) dt
  ON f.donor_name = dt.donor_name
GROUP BY dt.donor_type ORDER BY 2 DESC, 1""")
def by_donor_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    dt = views.donor_types(t).withColumn("donor_name", recode("donor_name", DONOR_TYPE_RENAMES))
    j = lookup_inner(fact_a_clean(t), dt, "donor_name")
    out = rollups.sum_by(j, ["donor_type"], {MEASURE: MEASURE})
    return rollups.order_desc(out.select("donor_type", r4(MEASURE).alias(MEASURE)), MEASURE, ["donor_type"])


@register("by_recipient_year", ("A2",), W_A + f"""
SELECT recipient_name, year, round(coalesce(sum({MEASURE}), 0), 4) AS {MEASURE}
FROM fact_a_clean GROUP BY recipient_name, year""")
def by_recipient_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    fa = fact_a_clean(tables(spark, sf_dir))
    out = rollups.sum_by(fa, ["recipient_name", "year"], {MEASURE: MEASURE})
    return out.select("recipient_name", "year", r4(MEASURE).alias(MEASURE))


@register("by_income_group", ("J3", "A5", "A6", "O1"), W_A + f""",
rec AS (SELECT recipient_name, sum({MEASURE}) AS v FROM fact_a_clean GROUP BY recipient_name),
grp AS (SELECT DISTINCT recipient_name, income_group_name FROM fact_a_clean)
SELECT g.income_group_name, round(coalesce(sum(r.v), 0), 4) AS {MEASURE}
FROM rec r JOIN grp g ON r.recipient_name = g.recipient_name
GROUP BY g.income_group_name ORDER BY 2 DESC, 1""")
def by_income_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged re-aggregation: recipient totals, then income group taken from
    fact A itself (distinct recipient → group pairs, inner join).

    One scan: partial sums per (recipient, group) pair; the recipient's full
    total is put on each of its pairs with a window (so a recipient listed
    under two groups counts in both, as an inner join to the distinct pairs
    would), then summed per group."""
    fa = fact_a_clean(tables(spark, sf_dir))
    pairs = rollups.sum_by(fa, ["recipient_name", "income_group_name"], {"v": MEASURE})
    pairs = pairs.withColumn("v", F.sum("v").over(Window.partitionBy("recipient_name")))
    out = rollups.sum_by(pairs, ["income_group_name"], {MEASURE: "v"})
    return rollups.order_desc(out.select("income_group_name", r4(MEASURE).alias(MEASURE)),
                              MEASURE, ["income_group_name"])


@register("top10_donors", ("A1", "O2"), W_A + f"""
SELECT donor_name, round(coalesce(sum({MEASURE}), 0), 4) AS {MEASURE}
FROM fact_a_clean GROUP BY donor_name ORDER BY 2 DESC, 1 LIMIT 10""")
def top10_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fa = fact_a_clean(tables(spark, sf_dir))
    out = rollups.sum_by(fa, ["donor_name"], {MEASURE: MEASURE})
    return rollups.top_k(out.select("donor_name", r4(MEASURE).alias(MEASURE)), MEASURE, ["donor_name"], 10)
