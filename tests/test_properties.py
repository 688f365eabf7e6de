"""Oracle rules S12-S28 and operator properties."""

import datetime as dt

from pyspark.sql import functions as F

from opsight.functions.expr import num_text
from opsight.operators.actions import advance_watermark, cascade_delete, insert_if_absent, insert_rows
from opsight.operators.capacity import month_partition_rename
from opsight.operators.files import calendar_file_counts, clean_names
from opsight.operators.sessions import _decode
from opsight.operators.status import session_run_id
from opsight.plans.joins import without
from opsight.sources.fixtures import AS_OF_FILES, AS_OF_RUNS, fixtures
from tests.conftest import SF_SMALL


def test_session_run_id_parsing(spark):  # S12/S13: INSTR/SUBSTR from position 11 up to a space
    # Without a space after the id the script's SUBSTR has a negative length: no id.
    df = spark.createDataFrame([("DW_RUN_ID=123 X",), ("DW_RUN_ID=9",), (None,)], "c string")
    assert [r.i for r in df.select(session_run_id("c").alias("i")).collect()] == ["123", None, None]


def test_number_text_like_to_char(spark):  # S18
    df = spark.createDataFrame([(1234567,), (0,), (-5,), (10 ** 13,), (None,)], "n long")
    got = [r.t for r in df.select(num_text("n").alias("t")).collect()]
    assert got == ["       1,234,567", "               0", "              -5", "#" * 16, None]


def test_decode_matches_null_with_default(spark):  # S25
    df = spark.createDataFrame([(0,), (1,), (7,)], "b int")
    got = [r.s for r in df.select(_decode(F.col("b"), {0: "Not Blocking", 1: "Blocking"}, F.lit("?")).alias("s")).collect()]
    assert got == ["Not Blocking", "Blocking", "?"]


def test_round_half_up(spark):  # S17
    r = spark.range(1).select(F.round(F.lit(2.5), 0).alias("a"), F.round(F.lit(-2.5), 0).alias("b")).first()
    assert (r.a, r.b) == (3.0, -3.0)


def test_month_partition_rename(spark):  # S28 / C12
    p = spark.createDataFrame([("DW", "T", "P_20160300"), ("DW", "T", "P_20160315")], "owner string, table_name string, partition_name string")
    got = month_partition_rename(p).collect()
    assert [(r.partition_name, r.new_name) for r in got] == [("P_20160300", "P_20160229")]


def test_clean_names(spark):  # F17
    df = spark.createDataFrame([("a_b_c.dat.tmp",), ("x" * 40,)], "name string")
    r = clean_names(df).collect()
    assert [(x.renamed, x.stem, x.last_token) for x in r] == [("a_b_c.dat", "a_b", "c.dat.tmp")]


def test_calendar_rows_are_tasks_times_days(spark):  # F3 property
    fx = fixtures(spark, SF_SMALL)
    out = calendar_file_counts(fx.files, fx.tasks, fx.processed_files, AS_OF_FILES, "Customer#%", 28)
    n_tasks = fx.tasks.count()
    n_src = fx.processed_files.select("source_system_cd").distinct().count()
    assert out.count() == (n_tasks + n_src) * 29


def test_advance_never_past_yesterday(spark):  # D5 property
    fx = fixtures(spark, SF_SMALL)
    for task in ["Customer#000000005", "Customer#000000011", "Customer#000000030"]:
        new_tasks, log = advance_watermark(fx.tasks, fx.runs, AS_OF_RUNS, task, ("Customer#000000011",))
        r = log.first()
        assert r.new_key <= 20240130 and r.new_key >= r.old_key
        assert new_tasks.count() == fx.tasks.count()


def test_cascade_delete_leaves_no_orphans(spark):  # D13 property
    fx = fixtures(spark, SF_SMALL)
    ids = fx.batches.filter("load_status = 'AUDITFAILED'").select("batch_id")
    errors = fx.runs.select("run_id", F.lit("ORA-1").alias("message"))
    out = cascade_delete({"files": fx.files, "runs": fx.runs, "batches": fx.batches, "run_errors": errors}, ids)
    for name in ("files", "runs", "batches"):
        assert out[name].join(ids, "batch_id", "left_semi").count() == 0
    assert out["files"].count() == fx.files.join(ids, "batch_id", "left_anti").count()
    assert out["run_errors"].join(out["runs"], "run_id", "left_anti").count() == 0


def test_cascade_delete_does_not_shuffle_the_tables(spark):  # D13 at size
    fx = fixtures(spark, SF_SMALL)
    ids = fx.batches.filter("load_status = 'AUDITFAILED' AND record_count = 0")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as where the tables are large
    try:
        out = cascade_delete({"files": fx.files, "runs": fx.runs, "batches": fx.batches}, ids)
        for df in out.values():
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_without_many_keys(spark):  # D13: a bitmap of the keys, then the keys
    df = spark.range(-20000, 40000).selectExpr("CAST(id % 7 AS STRING) AS v", "if(id % 5 = 0, NULL, id div 2) AS k").unionAll(
        spark.sql("SELECT 'low', -9223372036854775808L UNION ALL SELECT 'none', NULL"))
    keys = spark.range(0, 20000, 3).selectExpr("id AS k").unionAll(spark.sql("SELECT -9223372036854775808L UNION ALL SELECT NULL"))
    want = df.join(keys, "k", "left_anti")
    for most in (0, 10**6):
        got = without(df, "k", keys, most=most)
        assert got.columns == want.columns and got.count() == want.count() == got.filter("k IS NULL OR k % 3 <> 0 OR k < 0").count()
        assert got.exceptAll(want).count() == 0
    plan = without(df, "k", keys, most=0)._jdf.queryExecution().executedPlan().toString()
    assert "__bits" in plan
    assert without(df.select("v", F.col("k").cast("decimal(20,0)").alias("k")), "k", keys, most=0).count() == want.count()


def test_insert_rows_ids_continue_the_sequence(spark):  # D14 / S27
    tgt = spark.createDataFrame([(5, "a"), (9, "b")], "id long, v string")
    rows = spark.createDataFrame([(None, "z"), (None, "y"), (None, "x")], "id long, v string")
    got = sorted((r.id, r.v) for r in insert_rows(tgt, rows, "id", [F.col("v")]).collect())
    assert got == [(5, "a"), (9, "b"), (10, "x"), (11, "y"), (12, "z")]


def test_insert_if_absent_is_idempotent(spark):  # D15
    tgt = spark.createDataFrame([(1, "a")], "k long, v string")
    rows = spark.createDataFrame([(1, "dup"), (2, "new"), (2, "new")], "k long, v string")
    once = insert_if_absent(tgt, rows, "k")
    twice = insert_if_absent(once, rows, "k")
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "new")]


def test_alert_checks_on_clean_input_are_empty(spark):  # must-return-empty convention
    from opsight.operators.status import failed_run_alerts, long_running
    fx = fixtures(spark, SF_SMALL)
    clean = fx.runs.filter("run_status NOT IN ('FAILED', 'RUNNING')")
    assert failed_run_alerts(clean).count() == 0
    assert long_running(clean, AS_OF_RUNS).count() == 0
    one = clean.limit(1).withColumn("run_status", F.lit("FAILED"))
    assert failed_run_alerts(clean.unionByName(one)).count() == 1


def test_reset_failed_batches(spark):  # D12, batch side
    from opsight.operators.actions import reset_failed_batches
    fx = fixtures(spark, SF_SMALL)
    out = reset_failed_batches(fx.batches)
    assert out.count() == fx.batches.count()
    assert out.filter("load_status = 'AUDITFAILED'").count() == 0
    assert reset_failed_batches(fx.batches, delta=True).count() == fx.batches.filter("load_status = 'AUDITFAILED'").count()


def test_invalid_objects_with_separate_subpartition_catalog(spark):  # C7 with two catalog views
    from opsight.operators.capacity import invalid_objects
    fx = fixtures(spark, SF_SMALL)
    parts = fx.ind_parts.drop("subpart_status")
    subparts = fx.ind_parts.select("index_owner", "index_name", "subpartition_name", "subpart_status")
    a = sorted(invalid_objects(fx.ind_parts, fx.indexes).collect())
    b = sorted(invalid_objects(parts, fx.indexes, ind_subparts=subparts).collect())
    assert a == b and len(a) > 0


def test_maintenance_report_tree(spark):  # SURVEY §3.2: master and the details of one segment
    from opsight.plans.reports import maintenance_report
    fx = fixtures(spark, SF_SMALL)
    rep = maintenance_report(fx.queue, fx.segments, fx.sessions, fx.log, fx.tasks, fx.longops, fx.sql, fx.stats,
                             fx.stat_names, "Brand#7", AS_OF_RUNS, log_session_key="id_4", log_days=30)
    assert set(rep) >= {"queue_summary", "queue_detail", "segment_space", "sibling_sessions", "longops_rollup"}
    assert rep["queue_summary"].count() > 0 and rep["queue_detail"].count() > 0
    assert rep["queue_detail"].filter("segment_name <> 'Brand#7'").count() == 0


def test_checklist_covers_known_queries_and_writes_sheets(spark):  # SURVEY §3.1
    import os
    import tempfile
    from opsight.plans.checklist import CHECKLIST, checklist, run_checklist
    from opsight.plans.registry import registry
    names = [q for _, _, qs, _ in CHECKLIST for q in qs]
    assert set(names) <= set(registry())
    assert len(checklist(spark, SF_SMALL)) == len(names)
    out = tempfile.mkdtemp(prefix="opsight-sheets-")
    paths = run_checklist(spark, SF_SMALL, out)
    assert len(paths) == len(names) and all(os.path.isdir(p) for p in paths)


def test_close_group_runs_log_counts_updates(spark):  # D10 count per task
    from pyspark.sql import functions as F
    from opsight.operators.actions import close_group_runs
    fx = fixtures(spark, SF_SMALL)
    new_runs, new_batches, log = close_group_runs(fx.tasks, fx.steps, fx.runs, fx.batches, AS_OF_RUNS, "Customer#%")
    closed = new_runs.join(fx.runs.select("run_id", F.col("run_status").alias("old")), "run_id") \
        .filter("old = 'RUNABLE' AND run_status = 'CLOSED'").count()
    assert log.agg(F.sum("updates")).first()[0] == closed > 0
    assert new_batches.count() == fx.batches.count()
    assert log.filter(~F.col("message").like(" Ended: Customer#% updates.")).count() == 0
