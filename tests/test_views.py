"""The stand-in views carry the damage the null and Unicode rules are for."""

import os

import pytest
from pyspark.sql import functions as F

from lintel.sources import views
from lintel.sources.tables import Tables

SF = os.environ.get("LINTEL_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def test_fact_b_has_null_and_padded_keys(t):
    fb = views.fact_b(t)
    assert fb.filter(F.col("reporting_org_ref").isNull()).count() > 0
    assert fb.filter(F.col("reporting_org_ref").endswith("\u00a0")).count() > 0
    assert fb.filter(F.col("x_recipient_code").startswith("9")).count() > 0  # region codes


def test_fact_a_has_blank_and_literal_na_codes(t):
    fa = views.fact_a(t)
    kinds = {r.aid_type for r in fa.select("aid_type").distinct().collect()}
    assert {None, "NA", "E01", "E02", "C01"} <= kinds
    assert fa.filter(F.col("short_description").isNull()).count() > 0


def test_publisher_map_is_many_to_many_with_an_unmapped_key(t):
    m = views.publisher_map(t)
    per = {r.reporting_org_ref: r.n for r in m.groupBy("reporting_org_ref").agg(F.count("*").alias("n")).collect()}
    assert max(per.values()) == 2
    assert m.filter(F.col("donor_code").isNull()).count() == 1
    assert m.filter(F.col("donor_name").contains("\u00a0")).count() > 0


def test_region_mapping_has_a_doubled_iso_code(t):
    r = views.region_mapping(t)
    dup = r.groupBy("recipient_iso3_code").count().filter("count > 1").count()
    assert dup == 1
