"""Plan checks: native where it should be, no one-task sort of raw rows."""

import re

import pytest

import __spark_entry__ as entry
from conftest import SMALL

NATIVE = ["p16_token_jaccard", "p17_text_concept", "a07_dominant_domain", "a08_summary_list", "e04_roc_auc", "x03_exact_shap", "w03_first_events"]


def plan_of(spark, name):
    df = entry.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_workers(spark, name):
    assert not re.search(r"Python|ArrowEval|MapInPandas", plan_of(spark, name))


@pytest.mark.parametrize("name", NATIVE + ["w01_stratified_split", "w04_kfold", "p07_sequential_id"])
def test_no_cartesian(spark, name):
    assert "CartesianProduct" not in plan_of(spark, name)


def test_group_limit_before_shuffle(spark):
    plan = plan_of(spark, "w03_first_events")
    assert plan.count("WindowGroupLimit") == 2  # partial and final


def test_filter_and_columns_reach_the_scan(spark):
    plan = entry.queries()["p30_catalogue_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan
