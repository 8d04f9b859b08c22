"""DuckDB SQL for the stand-in views of ``lintel.sources.views``.

Used only by the oracle strings in ``__spark_entry__.oracle_sql``: each query
there is ``WITH <views it needs> SELECT …`` over the driver's pre-registered
tables.  Keep every definition in step with its Spark twin.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["nation_codes"] = r"""
nation_codes AS (
  SELECT n.n_nationkey, n.n_regionkey,
         'X' || chr(65 + n.n_nationkey) AS iso2,
         CASE WHEN n.n_nationkey = 10 THEN 'XKV'
              ELSE 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') END AS iso3,
         replace(n.n_name, '_', ' ') AS display_name,
         replace(n.n_name, '_', ' ') ||
           CASE WHEN n.n_nationkey % 10 = 9 THEN ', regional'
                WHEN n.n_nationkey = 20 THEN ', unspecified' ELSE '' END AS recipient_name,
         r.r_name AS income_group_name,
         CASE WHEN n.n_regionkey <= 2 THEN 'DAC' WHEN n.n_regionkey = 3 THEN 'Multilateral'
              ELSE 'Non-DAC' END AS donor_type
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

VIEWS["fact_a"] = r"""
fact_a AS (
  SELECT l.l_orderkey * 8 + l.l_linenumber AS row_id,
         CAST(year(o.o_orderdate) AS BIGINT) AS year,
         CAST(s.s_nationkey AS BIGINT) AS donor_code,
         dn.display_name AS donor_name,
         CAST(c.c_nationkey AS BIGINT) AS recipient_code,
         rn.iso3 AS recipient_iso3_code, rn.recipient_name, rn.income_group_name,
         CASE WHEN p.p_size > 45 THEN '930' ELSE '160' END AS sector_code,
         p.p_type AS purpose_code,
         'Purpose ' || p.p_type AS purpose_name,
         CASE l.l_linenumber WHEN 7 THEN 'E01' WHEN 6 THEN 'E02' WHEN 5 THEN NULL
              WHEN 4 THEN 'NA' ELSE 'C01' END AS aid_type,
         l.l_extendedprice / 1e6 AS usd_disbursement,
         l.l_extendedprice * (1 - l.l_discount) / 1e6 AS usd_disbursement_deflated,
         p.p_name AS project_title,
         CASE WHEN l.l_linenumber = 3 THEN NULL ELSE lower(c.c_mktsegment) END AS short_description,
         CASE WHEN l.l_linenumber % 2 = 0 THEN NULL ELSE p.p_brand END AS long_description
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN nation_codes rn ON c.c_nationkey = rn.n_nationkey
  JOIN nation_codes dn ON s.s_nationkey = dn.n_nationkey
  WHERE year(o.o_orderdate) <= 2000
)"""

VIEWS["fact_b"] = r"""
fact_b AS (
  SELECT 'P' || CAST(o.o_custkey % 40 AS VARCHAR) || '-' || CAST(o.o_orderkey AS VARCHAR) AS iati_identifier,
         CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
              WHEN o.o_orderkey % 13 = 0 THEN 'P' || CAST(o.o_custkey % 40 AS VARCHAR) || chr(160)
              ELSE 'P' || CAST(o.o_custkey % 40 AS VARCHAR) END AS reporting_org_ref,
         CAST(year(o.o_orderdate) AS BIGINT) AS x_transaction_year,
         'Org (' || o.o_orderpriority || ')' AS funding_orgs,
         pt.types[1 + o.o_custkey % nullif(len(pt.types), 0)] AS x_sector_code,
         CASE WHEN o.o_orderkey % 97 = 0 THEN CAST(900 + nc.n_regionkey AS VARCHAR)
              ELSE nc.iso2 END AS x_recipient_code,
         o.o_totalprice AS x_transaction_value_usd,
         lower(c.c_mktsegment) || ' ' || pt.types[1 + o.o_custkey % nullif(len(pt.types), 0)] || ' '
           || o.o_orderpriority AS x_description
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation_codes nc ON c.c_nationkey = nc.n_nationkey
  CROSS JOIN (SELECT list_sort(list(DISTINCT p_type)) AS types FROM part WHERE p_type IS NOT NULL) pt
)"""

VIEWS["publisher_map"] = r"""
publisher_map AS (
  WITH pubs AS (SELECT DISTINCT c_custkey % 40 AS p FROM customer),
  m AS (
    SELECT p, p % 25 AS donor_code FROM pubs WHERE p <> 39
    UNION ALL SELECT p, (p + 1) % 25 FROM pubs WHERE p % 7 = 0 AND p <> 39
    UNION ALL SELECT p, CAST(NULL AS BIGINT) FROM pubs WHERE p = 39
  )
  SELECT 'P' || CAST(m.p AS VARCHAR) AS reporting_org_ref,
         CAST(m.donor_code AS BIGINT) AS donor_code,
         replace(n.n_name, '_', chr(160)) AS donor_name
  FROM m LEFT JOIN nation n ON m.donor_code = n.n_nationkey
)"""

VIEWS["region_mapping"] = r"""
region_mapping AS (
  SELECT CAST(900 + r_regionkey AS VARCHAR) AS recipient_code,
         'RG' || CAST(r_regionkey AS VARCHAR) || '_X' AS recipient_iso3_code,
         r_name || ', regional' AS recipient_name
  FROM region
  UNION ALL
  SELECT '911', 'RG1_X', r_name || ', regional' FROM region WHERE r_regionkey = 1
)"""

VIEWS["iso_table"] = r"""
iso_table AS (
  SELECT iso2, iso3 FROM nation_codes WHERE n_nationkey NOT IN (10, 23)
)"""

VIEWS["recipient_names"] = r"""
recipient_names AS (
  SELECT iso3 AS recipient_iso3_code, recipient_name FROM nation_codes
  UNION ALL
  SELECT recipient_iso3_code, recipient_name FROM region_mapping
)"""

VIEWS["donor_types"] = r"""
donor_types AS (
  SELECT CASE WHEN n_nationkey = 3 THEN 'Nation Three' ELSE display_name END AS donor_name,
         donor_type
  FROM nation_codes WHERE n_nationkey <> 24
)"""

VIEWS["texts"] = r"""
texts AS (
  SELECT d.*, (lb.toxic = 1) AS false_positive
  FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id
)"""

# Which views each view needs (for building the WITH clause in order).
DEPENDS = {
    "nation_codes": [],
    "fact_a": ["nation_codes"],
    "fact_b": ["nation_codes"],
    "publisher_map": [],
    "region_mapping": [],
    "iso_table": ["nation_codes"],
    "recipient_names": ["nation_codes", "region_mapping"],
    "donor_types": ["nation_codes"],
    "texts": [],
}


def with_views(*names: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, in order,
    followed by any ``extra`` CTE texts (``name AS (…)``)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [VIEWS[n].strip() for n in order] + [e.strip() for e in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"
