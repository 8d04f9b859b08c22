"""Cross-report identities and band ordering on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = os.environ.get("LINTEL_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
M = "usd_disbursement_deflated"


def total(df, c):
    return df.agg(F.sum(c)).first()[0]


def test_totals_agree_across_reports(spark):
    q = E.queries()
    by_donor = total(q["total_by_donor"](spark, SF), M)
    by_year = total(q["total_by_year"](spark, SF), M)
    by_recip = total(q["by_recipient_year"](spark, SF), M)
    by_income = total(q["by_income_group"](spark, SF), M)
    assert by_donor == pytest.approx(by_year, abs=1e-3)
    assert by_recip == pytest.approx(by_year, abs=1e-3)
    assert by_income == pytest.approx(by_year, abs=1e-3)
    # The donor-type lookup lacks one donor: an inner join can only lose value.
    assert total(q["by_donor_type"](spark, SF), M) <= by_donor + 1e-6


def test_modelled_year_equals_recipient_band_sums(spark):
    q = E.queries()
    year = q["actuals_plus_modelled"](spark, SF).filter(F.col("usd_disbursement_lwr").isNotNull()).first()
    recip = q["clamp_and_deflate"](spark, SF)
    assert total(recip, M) == pytest.approx(year[M], abs=1e-3)
    assert total(recip, "usd_disbursement_lwr") == pytest.approx(year["usd_disbursement_lwr"], abs=1e-3)


def test_bands_are_ordered(spark):
    q = E.queries()
    for name, (v, lo, hi) in {"clamp_and_deflate": (M, "usd_disbursement_lwr", "usd_disbursement_upr"),
                              "nowcast_band": ("fit", "lwr", "upr"),
                              "fixed_effect_nowcast": ("fit", "lwr", "upr")}.items():
        df = q[name](spark, SF).filter(F.col(v).isNotNull())
        bad = df.filter((F.col(lo) > F.col(v) + 1e-9) | (F.col(v) > F.col(hi) + 1e-9)).count()
        assert bad == 0, name


def test_split_conserves_and_screen_matches_hits(spark):
    q = E.queries()
    assert q["split_conserves_total"](spark, SF).first().conserved
    screened = {r.doc_id for r in q["keyword_screen"](spark, SF).collect()}
    from lintel.operators import text
    from lintel.sources.keywords import document_keywords
    from lintel.sources.tables import Tables
    docs = Tables(spark, SF).documents
    hits = {r.doc_id for r in text.hit_table(docs, "doc_id", ["text"], document_keywords()).collect()}
    src_hits = {r.doc_id for r in text.hit_table(docs, "doc_id", ["source"], document_keywords()).collect()}
    assert screened == hits | src_hits
