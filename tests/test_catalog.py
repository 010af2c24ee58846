"""Registered queries: registry rules, checks on the smallest tables, plans."""

import re

import pytest

from compare import compare, connect

SF = "/root/testdata/sf0.001"
LIGHT = [
    "preset_hot_deals", "deals_page_name_store", "topk_per_store_category", "store_summary", "insights", "score_bands",
    "price_parse", "unit_price", "food_filter", "keyword_category", "counter_price_fix", "dedupe_keep_last",
    "archive_append", "new_vs_known", "prefix_match", "cross_store_rank", "name_clusters", "report_rollup",
    "quarterly_rollup", "page_region_join", "parse_delimited", "stream_weekly_stats", "historical_stats",
]


@pytest.fixture(scope="module")
def catalog():
    import __spark_entry__ as entry

    return entry.queries(), entry.oracle_sql()


def test_every_check_has_a_query(catalog):
    queries, checks = catalog
    assert set(checks) <= set(queries) and len(queries) > 120


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_its_check(spark, catalog, name):
    queries, checks = catalog
    assert compare(queries[name](spark, SF), connect(SF), checks[name], []) == ""


@pytest.mark.parametrize("name", ["historical_stats", "prefix_match", "keyword_overlap_match", "name_clusters", "cross_store_rank"])
def test_plans_have_no_cross_join_and_no_python(spark, catalog, name):
    plan = catalog[0][name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|ArrowEvalPython", plan)


def test_filters_and_columns_reach_the_scan(spark, catalog):
    plan = catalog[0]["preset_hot_deals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(deal_score), GreaterThanOrEqual(deal_score,80.0)]" in plan
    assert "price_text" not in plan.split("ReadSchema")[1]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "deal_score" in df.columns
