"""Oracle-rule and operator semantics on tiny literal tables."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsight.functions.expr import hms_text, key_to_date, round_duration, trunc_num, txt
from opsight.operators.actions import merge_update, set_status
from opsight.operators.batches import empty_batches
from opsight.operators.status import task_status_rollup
from opsight.plans.joins import not_in, suffix_join
from opsight.plans.numbering import global_row_number


def test_concat_treats_null_as_empty(spark):  # S1
    r = spark.range(1).select(txt("a", F.lit(None).cast("string"), "b").alias("x")).first()
    assert r.x == "ab"


def test_impossible_key_is_null(spark):  # S21
    r = spark.range(1).select(key_to_date(F.lit(20160931)).alias("d"), key_to_date(F.lit(20160930)).alias("e")).first()
    assert r.d is None and r.e == dt.date(2016, 9, 30)


def test_trunc_toward_zero(spark):  # S15
    r = spark.range(1).select(trunc_num(F.lit(-2.567), 2).alias("a"), trunc_num(F.lit(2.567), 2).alias("b")).first()
    assert (r.a, r.b) == (-2.56, 2.56)


def test_duration_text_and_null(spark):
    r = spark.range(1).select(hms_text(F.lit(3725.9)).alias("a"), hms_text(F.lit(None).cast("double")).alias("b")).first()
    assert r.a == "1H:2m:5s" and r.b == "H:m:s"


def test_exact_duration_tie_rounds_up(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 0, 8, 700000))], "s timestamp_ntz, e timestamp_ntz")
    assert df.select(round_duration("s", "e", 60, 2).alias("m")).first().m == 0.15


def test_not_in_with_null_returns_nothing(spark):  # S11
    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    sub_null = spark.createDataFrame([("a",), (None,)], "v string")
    sub = spark.createDataFrame([("a",)], "v string")
    empty = spark.createDataFrame([], "v string")
    assert not_in(df, "t", sub_null, "v").count() == 0
    assert [r.t for r in not_in(df, "t", sub, "v").collect()] == ["b"]
    assert not_in(df, "t", empty, "v").count() == 3


def test_suffix_join_matches_like(spark):
    left = spark.createDataFrame([("S.FCT_A",), ("S.DIM_B",), ("X",)], "name string")
    right = spark.createDataFrame([("FCT_A",), ("_B",), ("Q",)], "t string")
    got = sorted((r.name, r.t) for r in suffix_join(left, "name", right, "t").collect())
    assert got == [("S.DIM_B", "_B"), ("S.FCT_A", "FCT_A")]


def test_global_row_number_equals_window(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    a = global_row_number(df, [F.col("k").desc()], "rn")
    b = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("k").desc())))
    assert sorted(a.collect()) == sorted(b.collect())


def _runs(spark, rows):
    return spark.createDataFrame(rows, "run_id long, task_id long, batch_id long, task string, run_status string, "
                                       "start_date timestamp_ntz, end_date timestamp_ntz, rows_loaded long, "
                                       "rows_error long, rows_inserted long, rows_updated long, diy_parameter string, remark string")


def test_status_buckets_add_up(spark):
    t0 = dt.datetime(2024, 1, 1)
    runs = _runs(spark, [(i, 1, i, "T", s, t0, t0 + dt.timedelta(seconds=i), 10, 0, 0, 0, "20240101", None)
                         for i, s in enumerate(["RUNABLE", "RUNNING", "CLOSED", "SUCCESS", "FAILED", "HOLD_X", None])])
    tasks = spark.createDataFrame([(1, "T", "FILE", "Yes", 4), (2, "U", "FILE", "Yes", 4)],
                                  "task_id long, task string, task_type string, is_runnable string, max_file_load_concurrency long")
    r = {x.task: x for x in task_status_rollup(tasks, runs, "%", "%PATTERN%").collect()}
    t = r["T"]
    assert (t.queue, t.busy, t.done, t.fail, t.other) == (1, 1, 2, 1, 1)
    assert t.percentage_completed == 60.0
    assert (r["U"].queue, r["U"].percentage_completed) == (0, None)


def test_set_status_keeps_rows_and_is_idempotent(spark):
    t0 = dt.datetime(2024, 1, 1)
    runs = _runs(spark, [(1, 1, 1, "A", "FAILED", t0, None, None, 0, 0, 0, "x", None),
                         (2, 1, 2, "B", "CLOSED", t0, None, None, 0, 0, 0, "x", None)])
    pred = F.col("run_status") == "FAILED"
    once = set_status(runs, pred, "RUNABLE")
    twice = set_status(once, pred, "RUNABLE")
    assert once.count() == 2 and sorted(once.collect()) == sorted(twice.collect())
    assert set_status(runs, pred, "RUNABLE", delta=True).count() == 1


def test_merge_update_sets_matched_only(spark):
    tgt = spark.createDataFrame([("a", None), ("b", "x")], "name string, v string")
    src = spark.createDataFrame([("a", "new"), ("c", "zzz")], "name string, v string")
    assert sorted(merge_update(tgt, src, "name", ["v"]).collect()) == [("a", "new"), ("b", "x")]


def test_empty_batches_must_be_empty_then_flags_fault(spark):
    t0 = dt.datetime(2024, 1, 20)
    batches = spark.createDataFrame(
        [(1, 1, "S.T", 20240120, "LOADED", 5, "N", None, t0)],
        "batch_id long, task_id long, table_name string, dw_date_key int, load_status string, record_count long, "
        "super_batch_ind string, super_batch_id long, create_datetime timestamp_ntz")
    tasks = spark.createDataFrame([(1, "TG_CDR_X")], "task_id long, task string")
    runs = _runs(spark, [(9, 1, 1, "TG_CDR_X", "CLOSED", t0, t0, 100, 0, 0, 0, "20240120", None)])
    as_of = dt.datetime(2024, 1, 25)
    assert empty_batches(batches, tasks, runs, as_of).count() == 0
    bad = batches.withColumn("record_count", F.lit(0).cast("long"))
    assert empty_batches(bad, tasks, runs, as_of).count() == 1


def test_long_batch_ids_and_names_are_whole(spark):
    import datetime as dt
    from opsight.operators.capacity import placement_check
    d = dt.datetime(2024, 1, 5)
    batches = spark.createDataFrame([(1234567890, 20240105, d), (123456789, 20240106, d)], "batch_id long, dw_date_key int, create_datetime timestamp_ntz")
    parts = spark.createDataFrame([("DW", "T", "P_1234567890", "TS_STG_X")], "table_owner string, table_name string, partition_name string, tablespace_name string")
    meta = spark.createDataFrame([("T", "TS_STG_{YYYYMM}")], "table_name string, tablespace_variable string")
    assert [r.dw_date_key for r in placement_check(batches, parts, meta, "TS_STG%").collect()] == [20240105]
    name = "S." + "x" * 130
    left = spark.createDataFrame([(1, "${A}" + name), (2, None), (3, "other")], "i int, name string")
    right = spark.createDataFrame([(name,), (None,)], "t string")
    assert [r.i for r in suffix_join(left, "name", right, "t").collect()] == [1]
    assert sorted(r.i for r in suffix_join(left, "name", right, "t", how="left").collect()) == [1, 2, 3]


def test_tasks_of_one_name_are_one_row(spark):
    import datetime as dt
    from opsight.operators.files import file_status_pivot
    from opsight.operators.status import task_status_rollup
    t = spark.createDataFrame([(1, "A S2C", "Yes"), (2, "A S2C", "Yes")], "task_id long, task string, is_runnable string")
    at = dt.datetime(2024, 1, 5)
    f = spark.createDataFrame([(1, "LOADED", at, 5, 5, 0), (2, "FAILED", None, 7, 6, 1)],
                              "task_id long, processing_status string, start_datetime timestamp_ntz, row_count long, base_row_count long, bad_row_count long")
    got = file_status_pivot(f, t, at, 30).collect()
    assert len(got) == 1 and (got[0].row_count, got[0].nr_files, got[0].fail_c) == (12, 2, 1)
    full = t.selectExpr("*", "'FILE' AS task_type", "'LOAD' AS parameter_type", "'x' AS task_business_area", "'y' AS task_technical_area",
                        "1 AS max_file_load_concurrency")
    runs = spark.createDataFrame([(1, "RUNNING", at, None, 5, 0, 0, 0, "20240105"), (2, "CLOSED", at, at, 6, 0, 0, 0, "20240105")],
                                 "task_id long, run_status string, start_date timestamp_ntz, end_date timestamp_ntz, rows_loaded long, rows_error long, "
                                 "rows_inserted long, rows_updated long, diy_parameter string")
    rows = task_status_rollup(full, runs, "%S2C%").collect()
    assert len(rows) == 1 and (rows[0].busy, rows[0].done) == (1, 1)


def test_numbering_shuffles_rows_once(spark):
    df = spark.range(0, 4000, numPartitions=5).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 50).alias("wide"))
    out = global_row_number(df, [F.col("k").desc()], "rn")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The sorted rows are read back; only the partitions' counts are exchanged, and broadcast.
    assert "BroadcastHashJoin" in plan and "rangepartitioning" not in plan
    for line in plan.split("\n"):
        assert "Exchange hashpartitioning" not in line or "wide" not in line
    assert out.agg(F.sum("rn"), F.max("rn")).first() == (4000 * 4001 // 2, 4000)


def test_numbering_of_hot_and_equal_keys(spark):
    """A third of the rows share the first order column; fewer rows than partitions; no rows."""
    df = spark.range(0, 3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    got = global_row_number(df, [F.col("k"), F.col("i")], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("k", "i")))
    assert sorted(got.collect()) == sorted(want.collect())
    assert [r.rn for r in global_row_number(spark.range(1), [F.col("id")]).collect()] == [1]
    assert global_row_number(spark.range(0), [F.col("id")]).count() == 0


def test_numbering_of_wide_rows_over_several_partitions(spark):
    df = spark.range(0, 60_000, numPartitions=7).select((F.col("id") * 7919 % 60_000).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("t"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    got = global_row_number(df, [F.col("k").desc()], "rn").select("rn", "k", F.length("t").alias("w")).collect()
    assert sorted((r.rn, r.k, r.w) for r in got) == [(60_000 - k, k, 256) for k in range(59_999, -1, -1)]


def _waits(spark, links):
    return spark.createDataFrame(links, "sid long, blocking_session long")


def test_final_blockers_of_chains_rings_and_strangers(spark):
    from opsight.operators.sessions import final_blockers
    chain = [(k, k - 1) for k in range(101, 140)] + [(100, None)]                 # 100 blocks all
    ring = [(201, 202), (202, 203), (203, 201), (204, 201), (205, 204)]            # no end; two hang on it
    other = [(301, 999), (302, 301), (303, 303), (304, 303), (None, 100), (400, None), (306, 305), (306, 100)]
    got = {r.sid: (r.final, r.depth) for r in final_blockers(_waits(spark, chain + ring + other)).collect()}
    want = {k: (100, k - 100) for k in range(101, 140)} | {k: (None, None) for k in (201, 202, 203, 204, 205, 303, 304)}
    want |= {301: (999, 1), 302: (999, 2), 306: (100, 1)}
    assert got == want
    assert final_blockers(_waits(spark, [(1, None)])).count() == 0
    assert final_blockers(_waits(spark, [(1, 2), (2, 1)])).filter("final IS NULL").count() == 2


def test_final_blockers_take_few_rounds(spark):
    from opsight.operators import sessions
    rounds, plain = [], sessions.cut_lineage
    sessions.cut_lineage = lambda df: rounds.append(1) or plain(df)
    try:
        got = sessions.final_blockers(_waits(spark, [(k, k - 1) for k in range(1, 300)])).agg(F.min("final"), F.max("final"), F.max("depth")).first()
    finally:
        sessions.cut_lineage = plain
    assert got == (0, 0, 299) and len(rounds) <= 11                                # log2(299) joins, not 299


def test_next_tablespace(spark):
    from opsight.operators.lookups import next_tablespace
    cols = "owner string, table_name string, partition_name string, tablespace_name string"
    calendar = spark.createDataFrame([("A", "T", "P_20240105", "S5"), ("A", "T", "P_20240110", "S10"), ("A", "T", "P_20240110", "S09"),
                                      ("A", "T", "P_20240100", "BAD"), ("A", "U", "P_x", "BAD"), ("B", "T", "P_20240107", "B7")], cols)
    asked = spark.createDataFrame([("A", "T", "P_20240101"), ("A", "T", "P_20240105"), ("A", "T", "P_20240106_S1"), ("A", "T", "P_20240111"),
                                   ("A", "U", "P_20240101"), ("C", "T", "P_20240101"), ("A", "T", "P_never"), ("A", "T", "P_20240105")],
                                  "owner string, table_name string, partition_name string")
    got = sorted((r.owner, r.table_name, r.partition_name, r.next_tablespace or "") for r in next_tablespace(asked, calendar).collect())
    assert got == sorted([("A", "T", "P_20240101", "S5"), ("A", "T", "P_20240105", "S5"), ("A", "T", "P_20240105", "S5"), ("A", "T", "P_20240106_S1", "S09"),
                          ("A", "T", "P_20240111", "S09"), ("A", "U", "P_20240101", ""), ("C", "T", "P_20240101", ""), ("A", "T", "P_never", "")])


def test_intervals(spark):
    from opsight.functions.expr import interval_between, interval_text, numtodsinterval
    t0 = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(t0, t0 + dt.timedelta(days=3, hours=1, seconds=2, microseconds=500), 90.5), (t0, t0 - dt.timedelta(seconds=61), -1.25), (t0, None, None)],
                               "a timestamp_ntz, b timestamp_ntz, n double")
    out = df.select(interval_between("a", "b").alias("iv"), numtodsinterval("n", "MINUTE").alias("nv"))
    assert [f.dataType.simpleString() for f in out.schema] == ["interval day to second"] * 2
    assert [r.iv for r in out.collect()] == [dt.timedelta(days=3, hours=1, seconds=2, microseconds=500), dt.timedelta(seconds=-61), None]
    assert [r.nv for r in out.collect()] == [dt.timedelta(minutes=90.5), dt.timedelta(minutes=-1.25), None]
    text = [tuple(r) for r in out.select(interval_text(F.col("iv")), interval_text(F.col("nv"))).collect()]
    assert text == [("+000000003 01:00:02.000500", "+000000000 01:30:30.000000"), ("-000000000 00:01:01.000000", "-000000000 00:01:15.000000"), (None, None)]


def test_lock_rows_of_a_hot_object(spark):
    from opsight.operators.sessions import lock_modes
    locked = spark.createDataFrame([(1, 10, 3, "U1")], "object_id long, session_id long, locked_mode int, oracle_username string")
    objects = spark.createDataFrame([(1, "O", "T_1", "TABLE")], "object_id long, owner string, object_name string, object_type string")
    locks = spark.createDataFrame([(k, 1, 5, 0, 0, 6, "TX") for k in range(40)] + [(99, 1, 5, 1, 0, 6, "TX")],
                                  "sid long, id1 long, id2 long, block int, request int, lmode int, type string")
    sessions = spark.createDataFrame([(10, "u")], "sid long, username string")
    counted = lock_modes(locked, objects, locks, sessions, "T%").collect()
    rows = lock_modes(locked, objects, locks, sessions, "T%", expand=True)
    assert sorted(r.lock_count for r in counted) == [1, 40]
    assert rows.count() == 41 and rows.columns == [c for c in counted[0].asDict() if c != "lock_count"]
