"""Plan shape: filters reach the scan, no cartesian products, facts aggregated before joins."""

import pytest

from opsight.plans.registry import registry
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filter_pushed_to_files_scan(spark):
    p = plan(registry()["bad_row_rate"].build(spark, SF_SMALL))
    assert "PushedFilters" in p and "l_shipdate" in p.split("PushedFilters")[1][:400]


@pytest.mark.parametrize("name", ["task_status_rollup", "bad_row_rate", "calendar_file_counts", "file_run_status",
                                  "provision_shortfall", "blocking_pairs", "queue_space", "failing_tasks_by_message"])
def test_no_cartesian_product(spark, name):
    p = plan(registry()[name].build(spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_projection_pruned_at_scan(spark):
    p = plan(registry()["hourly_registrations"].build(spark, SF_SMALL))
    schema = p.split("ReadSchema:")[1].split("\n")[0]
    assert "l_extendedprice" not in schema and "l_shipdate" in schema


@pytest.mark.parametrize("name", ["task_status_rollup", "failed_run_detail", "bad_row_rate", "unarchived_files",
                                  "queue_backlog", "run_speed_today"])
def test_no_sort_merge_join_to_tasks(spark, name):
    # The task dimension is small here: the planner broadcasts it (a size it has checked).
    p = plan(registry()[name].build(spark, SF_SMALL))
    assert "SortMergeJoin" not in p


def test_hour_bound_reaches_the_scan(spark):
    p = plan(registry()["hourly_throughput"].build(spark, SF_SMALL))
    assert "GreaterThanOrEqual(ts" in p.split("PushedFilters")[1][:600]


def test_run_board_finds_the_runs_of_the_day_once(spark):
    p = plan(registry()["run_board"].build(spark, SF_SMALL))
    assert p.count("Exchange") <= 16 and p.count("events.parquet") <= 2


def test_lag_text_keeps_rows_without_a_copied_batch_out_of_the_join(spark):
    p = plan(registry()["stream_lag_text"].build(spark, SF_SMALL))
    assert "LeftOuter" not in "".join(x for x in p.split("\n") if "copied_batch_id" in x)


def test_partition_trend_prunes_at_run_time(spark):
    assert "dynamicpruning" in plan(registry()["partition_trend"].build(spark, SF_SMALL)).lower()
