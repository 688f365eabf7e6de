"""One small literal-table test per Oracle rule the operators rely on."""

import datetime as dt

from pyspark.sql import functions as F

from opsight.functions.expr import day_start, ratio, txt
from opsight.operators.lag import business_area_lag
from opsight.operators.status import recent_run_profile, run_times, scheduled_not_running, wait_time_topn

T0 = dt.datetime(2024, 1, 10, 8, 0)
RUN_DDL = ("run_id long, task_id long, batch_id long, task string, run_status string, start_date timestamp_ntz, "
           "end_date timestamp_ntz, rows_loaded long, rows_error long, rows_inserted long, rows_updated long, "
           "diy_parameter string, direct_exec_sql string, remark string")


def runs(spark, rows):
    return spark.createDataFrame(rows, RUN_DDL)


def run(i, task="T", status="CLOSED", start=T0, end=None, rows=10, diy="20240110", batch=None):
    return (i, 1, batch or i, task, status, start, end, rows, 0, 0, 0, diy, None, "x;1")


def test_s2_empty_text_is_null_in_concat(spark):  # '' is NULL; NULL || x = x
    r = spark.range(1).select(txt(F.lit(None).cast("string"), "x").alias("a")).first()
    assert r.a == "x"


def test_s3_null_order_is_explicit(spark):  # Oracle: NULLs last on DESC when written so
    df = runs(spark, [run(1, start=T0), run(2, start=None), run(3, start=T0 + dt.timedelta(hours=1))])
    order = [r.run_id for r in run_times(df, ["T"]).collect()]
    assert order == [3, 1, 2]


def test_s4_rownum_top_n_has_a_total_order(spark):  # ROWNUM < 7 after ORDER BY -> limit 6 with tie-break
    df = runs(spark, [run(i, status="RUNABLE", start=T0) for i in range(10)])
    b = spark.createDataFrame([], "batch_id long, dw_date_key int, copied_batch_id long")
    got = [r.run_id for r in wait_time_topn(df, b, T0 + dt.timedelta(hours=2), ("T",)).collect()]
    assert got == [9, 8, 7, 6, 5, 4]


def test_s8_and_binds_tighter_than_or(spark):  # a OR b AND closed
    df = runs(spark, [run(1, task="A", status="FAILED"), run(2, task="B", status="FAILED"),
                      run(3, task="B", status="CLOSED")])
    lit_ids = sorted(r.batch_id for r in recent_run_profile(df, T0, "A", "B").collect())
    intent = sorted(r.batch_id for r in recent_run_profile(df, T0, "A", "B", literal_precedence=False).collect())
    assert lit_ids == [1, 3] and intent == [3]


def test_s9_s10_like_wildcards(spark):  # '_' matches any char; '%%%%' matches any non-null
    df = spark.createDataFrame([("TF_A",), ("TFXA",), (None,)], "t string")
    assert df.filter(F.col("t").like("TF_A")).count() == 2
    assert df.filter(F.col("t").like("%%%%")).count() == 2


def test_s14_replace_without_replacement_deletes(spark):
    r = spark.range(1).select(F.replace(F.lit("a/b/c"), F.lit("/"), F.lit("")).alias("x")).first()
    assert r.x == "abc"


def test_s16_trunc_date_is_midnight(spark):
    df = spark.createDataFrame([(T0,)], "t timestamp_ntz")
    assert df.select(day_start("t").alias("d")).first().d == dt.datetime(2024, 1, 10)


def test_s20_bad_casts_give_null(spark):
    r = spark.range(1).select(F.lit("12a").try_cast("int").alias("a"), F.lit("12").try_cast("int").alias("b")).first()
    assert (r.a, r.b) == (None, 12)


def test_s22_division_by_zero_is_null(spark):
    r = spark.range(1).select(ratio(F.lit(5), F.lit(0)).alias("a"), ratio(F.lit(5), F.lit(2)).alias("b")).first()
    assert (r.a, r.b) == (None, 2.5)


def test_s24_minus_is_a_distinct_difference(spark):
    sched = spark.createDataFrame([("j1", "SCHEDULED"), ("j1", "SCHEDULED"), ("j2", "SCHEDULED")],
                                  "job_name string, job_status string")
    jobs = spark.createDataFrame([("DW_META", "j2", "RUNNING")], "owner string, job_name string, state string")
    assert [r.job_name for r in scheduled_not_running(sched, jobs, "DW_META").collect()] == ["j1"]


def test_s26_lag_sign_trimmed_to_days_behind(spark):  # TRIM('-' FROM n) as the absolute value
    tasks = spark.createDataFrame([(1, "T1", "Yes", "AREA")], "task_id long, task string, is_runnable string, "
                                                             "task_business_area string")
    steps = spark.createDataFrame([(1, "T1", "S.FCT_X")], "task_id long, task string, target_table_name string")
    r = runs(spark, [run(1, task="T1", diy="20240105", batch=99)])
    b = spark.createDataFrame([], "batch_id long, dw_date_key int")
    out = business_area_lag(tasks, steps, r, b, dt.datetime(2024, 1, 10)).first()
    assert out.status == "4 DAYS BEHIND" and out.max_date_key == "20240105"
