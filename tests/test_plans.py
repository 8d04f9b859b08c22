"""Plan shape: pushdown, pruning, broadcast of small sides, no row-at-a-time
Python and no cartesian products anywhere in the registered queries."""

import os

import pytest

import __spark_entry__ as E

SF = os.environ.get("LINTEL_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def plan_of(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(spark, name) for name in E.queries()}


def test_no_row_at_a_time_python_or_cartesian(plans):
    for name, plan in plans.items():
        assert "BatchEvalPython" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_filters_reach_the_scan(plans):
    assert "PushedFilters: [" in plans["total_by_donor"]
    assert "PartitionFilters: [isnotnull(year" in plans["warehouse_extract"]
    # Only the needed columns are read from the fact.
    scan = [line for line in plans["total_by_donor"].splitlines() if "FileScan" in line][0]
    assert "project_title" not in scan and "row_id" not in scan


def test_split_broadcasts_the_mapping(plans):
    assert "BroadcastHashJoin" in plans["split_publisher_values"]
    assert "SortMergeJoin" not in plans["split_publisher_values"]


def test_keyword_work_needs_no_join(plans):
    for name in ("keyword_screen", "keyword_hits", "tfidf_unigrams"):
        assert "SortMergeJoin" not in plans[name], name


def test_aggregates_combine_before_the_shuffle(plans):
    for name in ("total_by_donor", "keyword_eval", "split_publisher_values"):
        assert "partial_" in plans[name], name
