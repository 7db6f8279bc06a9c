"""Physical plans: pruned scans, pushed filters, partial aggregation, no whole-table window."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ordersight.operators import aggregates as A
from ordersight.operators.quality import required_rows
from ordersight.sources.tables import table, transactions


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filter_pushed(spark, small):
    orders = table(spark, small, "events").select(F.col("value").alias("amount"), "user_id", F.col("event_id").alias("time_diff"))
    plan = plan_of(required_rows(orders).select("amount"))
    assert "IsNotNull(value)" in plan
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1).split(",")) == {"event_id:bigint", "value:double"}


def test_hourly_reads_only_what_it_needs(spark, small):
    plan = plan_of(A.hourly_distribution(transactions(spark, small)))
    assert "props" not in plan and "event_type" not in plan


def test_user_grouping_reuses_the_shuffle_of_the_gap(spark, small):
    per_user = transactions(spark, small).groupBy("user_id").agg(F.avg("time_diff"))
    assert plan_of(per_user).count("Exchange hashpartitioning") == 1


def test_top_k_is_not_a_full_sort(spark, small):
    plan = plan_of(A.user_profiling(transactions(spark, small)))
    assert "TakeOrderedAndProject" in plan and "partial_avg" in plan


LIGHT = [
    "user_profiling", "hourly_distribution", "device_analysis", "segment_by_amount", "score_histogram", "risk_by_hour",
    "attach_scores", "gap_seconds", "correlation_matrix", "daily_rollup", "acf", "series_clean", "null_profile",
    "maxnorm_score", "minmax_score", "zscore_features_population", "label_correlation_topk", "row_number_rank",
]


@pytest.mark.parametrize("name", LIGHT)
def test_no_window_over_the_whole_table(spark, small, name):
    """A window without partition keys may only follow a limit."""
    plan = plan_of(entry.queries()[name](spark, small))
    for line in plan.splitlines():
        if "Window [" in line:
            keys = re.search(r"windowspecdefinition\((\w+)#", line)
            assert keys, line
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", LIGHT)
def test_no_python_in_set_based_queries(spark, small, name):
    plan = plan_of(entry.queries()[name](spark, small))
    assert "Python" not in plan and "Pandas" not in plan


def test_rank_in_group_cuts_groups_before_the_shuffle(spark, small):
    plan = plan_of(entry.queries()["row_number_rank"](spark, small))
    assert plan.count("WindowGroupLimit") == 2
