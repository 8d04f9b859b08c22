"""Canonical stand-in views over the driver tables.

The reference reads two warehouse facts that are not available here (fact A:
official activity-level disbursements; fact B: raw transactions reaching one
year further) plus small dimensions.  These views derive tables with the same
columns from the TPC-H-like test tables, so every operator runs on data whose
size grows with the scale factor.  ``plans/oracle_views.py`` holds the same
definitions in DuckDB SQL; the two must stay in step.

Layout of the stand-ins (all derived by rule, nothing sampled):

* nation codes: ``iso2 = 'X' || chr(65 + key)``; ``iso3 = 'N' || lpad(key, 2)``
  except key 10 → ``XKV``; names get a ``, regional`` / ``, unspecified``
  suffix on a few keys; income group = region name.
* fact A = lineitem ⨝ orders ⨝ customer ⨝ supplier ⨝ part (+ nation codes),
  years up to 2000.  Codes with NULLs injected by line number.
* fact B = orders ⨝ customer ⨝ (all part types, dealt by ``o_custkey``), years 1995-2001,
  40 publishers ``P0..P39`` with NULL / no-break-space damage on some keys.
* publisher map: publisher p → donor ``p % 25`` plus ``(p+1) % 25`` when
  ``p % 7 = 0``; publisher 39 has no donor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators.joins import attach_scalars, small
from lintel.sources.tables import Tables

NBSP = "\u00a0"  # no-break space


def nation_codes(t: Tables) -> DataFrame:
    """Country dimension: key, codes, names, donor type and income group."""
    k = F.col("n_nationkey")
    display = F.regexp_replace("n_name", "_", " ")
    suffix = (F.when(k % 10 == 9, F.lit(", regional"))
              .when(k == 20, F.lit(", unspecified")).otherwise(F.lit("")))
    return (t.nation.join(small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(k.alias("n_nationkey"), "n_regionkey",
                    F.concat(F.lit("X"), F.expr("chr(65 + n_nationkey)")).alias("iso2"),
                    F.when(k == 10, F.lit("XKV"))
                     .otherwise(F.concat(F.lit("N"), F.lpad(k.cast("string"), 2, "0"))).alias("iso3"),
                    display.alias("display_name"),
                    F.concat(display, suffix).alias("recipient_name"),
                    F.col("r_name").alias("income_group_name"),
                    F.when(F.col("n_regionkey") <= 2, F.lit("DAC"))
                     .when(F.col("n_regionkey") == 3, F.lit("Multilateral"))
                     .otherwise(F.lit("Non-DAC")).alias("donor_type")))


def fact_a(t: Tables) -> DataFrame:
    """Fact A: one row per line item (activity-level disbursement)."""
    nc = nation_codes(t)
    rn = small(nc.select(F.col("n_nationkey").alias("_rk"), F.col("iso3").alias("recipient_iso3_code"),
                         "recipient_name", "income_group_name"))
    dn = small(nc.select(F.col("n_nationkey").alias("_dk"), F.col("display_name").alias("donor_name")))
    li = t.lineitem
    o = t.orders.filter("o_orderdate < TIMESTAMP_NTZ'2001-01-01'")
    ln = F.col("l_linenumber")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
         .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
         .join(rn, F.col("c_nationkey") == F.col("_rk"))
         .join(dn, F.col("s_nationkey") == F.col("_dk")))
    return j.select(
        (F.col("l_orderkey") * 8 + ln).alias("row_id"),
        F.year("o_orderdate").cast("bigint").alias("year"),
        F.col("s_nationkey").cast("bigint").alias("donor_code"),
        "donor_name",
        F.col("c_nationkey").cast("bigint").alias("recipient_code"),
        "recipient_iso3_code", "recipient_name", "income_group_name",
        F.when(F.col("p_size") > 45, F.lit("930")).otherwise(F.lit("160")).alias("sector_code"),
        F.col("p_type").alias("purpose_code"),
        F.concat(F.lit("Purpose "), F.col("p_type")).alias("purpose_name"),
        F.when(ln == 7, F.lit("E01")).when(ln == 6, F.lit("E02"))
         .when(ln == 5, F.lit(None).cast("string")).when(ln == 4, F.lit("NA"))
         .otherwise(F.lit("C01")).alias("aid_type"),
        (F.col("l_extendedprice") / 1e6).alias("usd_disbursement"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e6).alias("usd_disbursement_deflated"),
        F.col("p_name").alias("project_title"),
        F.when(ln == 3, F.lit(None).cast("string")).otherwise(F.lower("c_mktsegment")).alias("short_description"),
        F.when(ln % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("long_description"),
    )


def fact_b(t: Tables) -> DataFrame:
    """Fact B: one row per order (raw transaction), years 1995-2001."""
    nc = small(nation_codes(t).select(F.col("n_nationkey").alias("_rk"), "iso2", "n_regionkey"))
    o = t.orders
    pub = F.concat(F.lit("P"), (F.col("o_custkey") % 40).cast("string"))
    region_code = (F.lit(900) + F.col("n_regionkey")).cast("string")
    j = (o.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
         .join(nc, F.col("c_nationkey") == F.col("_rk")))
    # the part types are a small code list: one sorted row of it goes to every order
    j = attach_scalars(j, t.part.agg(F.array_sort(F.collect_set("p_type")).alias("_types")))
    purpose = F.get("_types", (F.col("o_custkey") % F.nullif(F.size("_types"), F.lit(0))).cast("int"))
    ok = F.col("o_orderkey")
    return j.select(
        F.concat(pub, F.lit("-"), ok.cast("string")).alias("iati_identifier"),
        F.when(ok % 50 == 0, F.lit(None).cast("string"))
         .when(ok % 13 == 0, F.concat(pub, F.lit(NBSP)))
         .otherwise(pub).alias("reporting_org_ref"),
        F.year("o_orderdate").cast("bigint").alias("x_transaction_year"),
        F.concat(F.lit("Org ("), F.col("o_orderpriority"), F.lit(")")).alias("funding_orgs"),
        purpose.alias("x_sector_code"),
        F.when(ok % 97 == 0, region_code).otherwise(F.col("iso2")).alias("x_recipient_code"),
        F.col("o_totalprice").alias("x_transaction_value_usd"),
        F.concat(F.lower("c_mktsegment"), F.lit(" "), purpose, F.lit(" "), F.col("o_orderpriority")).alias("x_description"),
    )


def publisher_map(t: Tables) -> DataFrame:
    """Publisher → donor mapping (many-to-many, one publisher unmapped).

    Donor names carry a no-break space where fact A has a plain space."""
    p = F.col("p")
    pubs = t.customer.select((F.col("c_custkey") % 40).alias("p")).distinct()
    first = pubs.filter(p != 39).select(p, (p % 25).alias("donor_code"))
    second = pubs.filter((p % 7 == 0) & (p != 39)).select(p, ((p + 1) % 25).alias("donor_code"))
    none = pubs.filter(p == 39).select(p, F.lit(None).cast("bigint").alias("donor_code"))
    m = first.unionByName(second).unionByName(none)
    names = small(t.nation.select(F.col("n_nationkey").cast("bigint").alias("_dk"),
                                  F.regexp_replace("n_name", "_", NBSP).alias("donor_name")))
    return (m.join(names, F.col("donor_code") == F.col("_dk"), "left")
            .select(F.concat(F.lit("P"), p.cast("string")).alias("reporting_org_ref"),
                    F.col("donor_code").cast("bigint").alias("donor_code"), "donor_name"))


def region_mapping(t: Tables) -> DataFrame:
    """Region codes → region ISO-like code and name.  One ISO code appears
    under two region codes (the duplicated-key defect, D1)."""
    base = t.region.select((F.lit(900) + F.col("r_regionkey")).cast("string").alias("recipient_code"),
                           F.concat(F.lit("RG"), F.col("r_regionkey").cast("string"), F.lit("_X")).alias("recipient_iso3_code"),
                           F.concat(F.col("r_name"), F.lit(", regional")).alias("recipient_name"))
    dup = (t.region.filter(F.col("r_regionkey") == 1)
           .select(F.lit("911").alias("recipient_code"), F.lit("RG1_X").alias("recipient_iso3_code"),
                   F.concat(F.col("r_name"), F.lit(", regional")).alias("recipient_name")))
    return base.unionByName(dup)


def iso_table(t: Tables) -> DataFrame:
    """ISO-2 → ISO-3 country table; lacks XK (override) and key 23 (unresolved)."""
    return (nation_codes(t).filter(~F.col("n_nationkey").isin(10, 23))
            .select("iso2", "iso3"))


def recipient_names(t: Tables) -> DataFrame:
    """Recipient code list: countries plus region rows (with the duplicate)."""
    c = nation_codes(t).select(F.col("iso3").alias("recipient_iso3_code"), "recipient_name")
    r = region_mapping(t).select("recipient_iso3_code", "recipient_name")
    return c.unionByName(r)


def donor_types(t: Tables) -> DataFrame:
    """Donor name → donor type; the last nation is absent (inner join drops it)
    and one name is spelled differently (fixed by a single-value rename)."""
    nc = nation_codes(t).filter(F.col("n_nationkey") != 24)
    name = F.when(F.col("n_nationkey") == 3, F.lit("Nation Three")).otherwise(F.col("display_name"))
    return nc.select(name.alias("donor_name"), "donor_type")


def texts(t: Tables) -> DataFrame:
    """Scored text rows: documents with a false-positive flag from labels
    (``toxic = 1``); unlabeled documents have a NULL flag."""
    lab = t.labels.select("doc_id", (F.col("toxic") == 1).alias("false_positive"))
    return t.documents.join(lab, "doc_id", "left")


def fact_a_table(t: Tables) -> DataFrame:
    """Fact A as a warehouse table (written once, partitioned by year)."""
    from lintel.sources.warehouse import materialized
    return materialized(t, "fact_a", fact_a, partition_by=["year"])


def fact_b_table(t: Tables) -> DataFrame:
    """Fact B as a warehouse table (written once, partitioned by year)."""
    from lintel.sources.warehouse import materialized
    return materialized(t, "fact_b", fact_b, partition_by=["x_transaction_year"])
