"""The keyword chain: kept rows, identities between its reports, bands of the comparison."""

from lintel.plans import q_keyword
from lintel.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_kept_rows(spark):
    rows = [(1, "red", "a household in the far north"), (2, "red", None), (3, None, None), (4, "reddish", "unhouseholdly matters"),
            (5, "Small gizmo", "of the usual kind here"), (6, "red", "a household in the far north"), (7, "", "")]
    df = spark.createDataFrame(rows, "id int, title string, descr string")
    got = q_keyword.kept_rows(df, ["title", "descr"])
    # 2 holds a keyword but its text is too brief; a copied text keeps every row
    assert sorted(r["id"] for r in got.collect()) == [1, 5, 6]
    assert got.columns == df.columns
    assert q_keyword.kept_rows(df.where("false"), ["title", "descr"]).count() == 0


def test_reports_agree(spark):
    r = QUERIES["keyword_totals_agree"](spark, SF).first()
    assert abs(r["by_donor"] - r["by_year"]) < 1e-3 and abs(r["by_recipient"] - r["by_income"]) < 1e-3
    assert r["by_donor"] > 0 and r["by_recipient"] >= r["by_donor"]


def test_bands_of_the_comparison(spark):
    rows = QUERIES["definition_comparison_modelled"](spark, SF).collect()
    for side in ("purpose", "keyword"):
        v = [(r[f"usd_disbursement_lwr_{side}"], r[f"usd_disbursement_deflated_{side}"], r[f"usd_disbursement_upr_{side}"])
             for r in rows]
        assert all(a <= b <= c for a, b, c in v)
    assert any(r["usd_disbursement_lwr_keyword"] < r["usd_disbursement_deflated_keyword"] < r["usd_disbursement_upr_keyword"]
               for r in rows)


def test_rows_are_screened_once(spark):
    """What follows the screening reads the written rows, not the texts again."""
    rows = [(i, "red", "a household in the far north") for i in range(3)]
    df = spark.createDataFrame(rows, "id int, title string, descr string")
    plan = q_keyword.kept_rows(df, ["title", "descr"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "Generate" not in plan
