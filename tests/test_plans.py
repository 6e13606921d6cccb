"""Physical plans of the registered queries."""

import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
FITTED = {"m10_train_predict", "m23_frame_rules", "m16_personas", "m17_attribution", "m23_prediction_frame"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in FITTED and not n.startswith("op") and n != "pipeline"))
def test_no_nested_loops_and_no_row_udfs(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan


@pytest.mark.parametrize("name, absent", [
    ("a1_event_counts_per_user", "props"), ("j3_bridge_daily", "o_totalprice"), ("a9_distinct_lists", "p_name"), ("j10_matrix", "props"),
    ("a32_kaplan_meier", "o_totalprice"), ("a18_percentiles_by_class", "o_orderdate")])
def test_scans_read_only_used_columns(spark, name, absent):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", plan_of(entry.queries()[name](spark, FOLDER)))
    assert schemas and all(absent not in schema for schema in schemas)


@pytest.mark.parametrize("name, column", [("f11_filters_combo", "c_acctbal"), ("s9_update_counts", "c_acctbal"), ("s8_upsert", "c_acctbal")])
def test_filters_reach_the_scan(spark, name, column):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert any(column in pushed for pushed in re.findall(r"PushedFilters: \[([^\]]*)", plan))
