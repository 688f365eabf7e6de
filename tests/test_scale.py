"""Scale properties: aggregate before join, hot keys, JVM-only plans, nothing collected."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from opsight.operators.status import task_status_rollup
from opsight.plans.registry import registry
from opsight.sources.fixtures import fixtures
from tests.conftest import ROOT, SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["task_status_rollup", "status_rollup_by_task_hour", "bad_row_rate",
                                  "unarchived_files", "stale_targets", "dormant_tasks", "queue_backlog"])
def test_facts_aggregated_before_dimension_join(spark, name):
    p = plan(registry()[name].build(spark, SF_SMALL))
    first_join = min(i for i in (p.find("Join"),) if i >= 0)
    partial = p.find("partial_", first_join)
    assert partial > first_join, "the fact side should reach the join already (partially) aggregated"


def test_hot_task_with_a_third_of_all_runs(spark):
    fx = fixtures(spark, SF_SMALL)
    runs = fx.runs
    hot = runs.withColumn("task_id", F.lit(7).cast("long"))
    skewed = runs.unionByName(hot).unionByName(hot.withColumn("run_id", F.col("run_id") + 10 ** 7))
    got = task_status_rollup(fx.tasks, skewed, "Customer#%", "%PATTERN%").filter("task = 'Customer#000000007'").first()
    n7 = skewed.filter("task_id = 7")
    assert got.queue == n7.filter("run_status = 'RUNABLE'").count()
    assert got.busy == n7.filter("run_status = 'RUNNING'").count()
    total = n7.agg(F.sum("rows_loaded")).first()[0]
    assert got.rows_loaded.strip() == f"{total:,}"


def test_no_python_udfs_in_any_plan(spark):
    for name, q in registry().items():
        p = plan(q.build(spark, SF_SMALL))
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF|FlatMapGroupsInPandas", p), name


def test_operators_never_collect_to_the_driver():
    for p in pathlib.Path(ROOT, "opsight").rglob("*.py"):
        src = p.read_text()
        assert not re.search(r"\.(collect|toPandas|toLocalIterator|localCheckpoint)\(", src), p


@pytest.mark.parametrize("name", ["stream_hourly", "stream_session_pivot", "hourly_registrations", "long_running",
                                  "registration_pivot", "parameter_check", "unarchived_files"])
def test_results_do_not_depend_on_session_time_zone(spark, name):
    from opsight.plans.registry import oracle_sql
    from tools.check_oracle import compare, duck
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        df = registry()[name].build(spark, SF_SMALL)
        assert compare(name, df, duck(SF_SMALL), oracle_sql(name), verbose=True)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_hot_key_join_is_split_by_adaptive_skew_handling(spark):
    """A task holding two thirds of the runs: AQE splits its partition (skew=true) and results stay exact."""
    from opsight.operators.status import failed_run_detail
    from opsight.sources.fixtures import Fixtures
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        fx = Fixtures(spark, SF_SMALL)
        hot = fx.runs.withColumn("task_id", F.lit(7).cast("long"))
        skewed = fx.runs.unionByName(hot).unionByName(hot.withColumn("run_id", F.col("run_id") + 10 ** 7))
        df = failed_run_detail(skewed, fx.tasks)
        rows = df.collect()
        p = plan(df)
        assert "isFinalPlan=true" in p and "skew=true" in p
        assert len(rows) == skewed.filter("run_status = 'FAILED'").join(fx.tasks.select("task_id"), "task_id").count()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
