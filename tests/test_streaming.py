"""Streams over split files give the batch result (availableNow)."""

import tempfile

from opsight.sources.fixtures import fixtures
from opsight.streaming.streams import first_arrivals, run_available_now, stream_dedup, stream_hourly
from tests.conftest import SF_SMALL


def test_hourly_stream_equals_batch(spark):
    files = fixtures(spark, SF_SMALL).files.select("short_filename", "register_datetime", "row_count")
    src = tempfile.mkdtemp(prefix="opsight-stream-src-")
    files.repartition(4).write.mode("overwrite").parquet(src)
    batch = stream_hourly(files, "register_datetime", "row_count")
    got = run_available_now(spark, src, files.schema, lambda d: stream_hourly(d, "register_datetime", "row_count"),
                            "st_hourly_test")
    # availableNow ends the stream; windows after the last watermark stay open.
    closed = batch.filter(batch.window_end <= got.agg({"window_end": "max"}).first()[0])
    assert sorted(got.collect()) == sorted(closed.collect())


def test_dedup_stream_keeps_one_per_name(spark):
    files = fixtures(spark, SF_SMALL).files.select("short_filename", "register_datetime")
    src = tempfile.mkdtemp(prefix="opsight-stream-src-")
    files.write.mode("overwrite").parquet(src)
    got = run_available_now(spark, src, files.schema, first_arrivals, "st_dedup_test")
    assert got.count() == got.select("short_filename").distinct().count() == files.select("short_filename").distinct().count()


def _log_source(spark):
    log = fixtures(spark, SF_SMALL).log.select("log_id", "task_id", "id_2", "message", "error_sysdate")
    src = tempfile.mkdtemp(prefix="opsight-stream-log-")
    log.repartition(3).write.mode("overwrite").parquet(src)
    return log, src


def test_session_stream_equals_batch_for_closed_sessions(spark):
    from pyspark.sql import functions as F
    from opsight.streaming.streams import stream_session_pivot
    log, src = _log_source(spark)
    got = run_available_now(spark, src, log.schema, stream_session_pivot, "st_sessions_test")
    batch = stream_session_pivot(log)
    wm = log.agg(F.max("error_sysdate")).first()[0]
    import datetime as dt
    closed = batch.filter(F.col("session_end") <= F.lit(wm - dt.timedelta(hours=1)).cast("timestamp_ntz"))
    assert got.count() > 0
    assert sorted(got.collect()) == sorted(closed.collect())


def test_interval_join_stream_matches_batch(spark):
    from opsight.streaming.streams import stream_start_end
    log, src = _log_source(spark)
    got = {tuple(r) for r in run_available_now(spark, src, log.schema, stream_start_end, "st_join_test").collect()}
    batch = {tuple(r) for r in stream_start_end(log).collect()}
    # A start is final once the watermark is a span past it.
    import datetime as dt
    last = max(r.error_sysdate for r in log.collect()) - dt.timedelta(days=1, hours=2)
    closed = {r for r in batch if r[3] is not None and r[2] < last}
    assert closed and got <= batch and closed <= got


def test_a_stream_run_again_adds_what_is_new(spark):
    import datetime as dt
    schema = "short_filename string, register_datetime timestamp_ntz"
    src = tempfile.mkdtemp(prefix="opsight-stream-again-")
    t0 = dt.datetime(2024, 1, 10, 12, 0)
    add = lambda *names: spark.createDataFrame([(n, t0) for n in names], schema).write.mode("append").parquet(src)
    run = lambda: sorted(r.short_filename for r in run_available_now(spark, src, spark.createDataFrame([], schema).schema, first_arrivals, "st_again_test").collect())
    add("a", "b", "a")
    assert run() == ["a", "b"]
    add("b", "c")
    assert run() == ["a", "b", "c"]


def test_one_row_for_each_start(spark):
    from opsight.streaming.streams import stream_start_end
    log = fixtures(spark, SF_SMALL).log
    out = stream_start_end(log)
    assert out.count() == log.filter("message LIKE '%Task: TF_%'").count()
    first = stream_dedup(fixtures(spark, SF_SMALL).files)
    assert first.count() == first.select("short_filename").distinct().count()


def test_late_rows_are_dropped(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    schema = "short_filename string, register_datetime timestamp_ntz, row_count long"
    src = tempfile.mkdtemp(prefix="opsight-stream-late-")
    t0 = dt.datetime(2024, 1, 10, 12, 0)
    on_time = spark.createDataFrame([("a", t0, 1), ("b", t0 + dt.timedelta(hours=5), 1)], schema)
    on_time.write.mode("append").parquet(src)
    name = "st_late_test"
    from opsight.session import checkpoint_dir
    ckpt = f"{checkpoint_dir(spark)}/stream-{name}"

    out = tempfile.mkdtemp(prefix="opsight-stream-out-")

    def run():
        q = (stream_hourly(spark.readStream.schema(schema).parquet(src), "register_datetime", "row_count")
             .writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    late = spark.createDataFrame([("c", t0 - dt.timedelta(hours=1), 7)], schema)
    late.write.mode("append").parquet(src)
    run()   # restarts from the checkpoint: the watermark survives the restart
    rows = spark.read.parquet(out).collect()
    assert all(r.window_start != dt.datetime(2024, 1, 10, 11, 0) for r in rows)
    assert any(r.window_start == dt.datetime(2024, 1, 10, 12, 0) for r in rows)


def test_sliding_window_counts_each_row_window_over_slide_times(spark):
    from pyspark.sql import functions as F
    files = fixtures(spark, SF_SMALL).files.select("register_datetime", "row_count", "processing_status")
    out = stream_hourly(files, "register_datetime", "row_count", window="2 hours", slide="1 hour",
                        keys=("processing_status",))
    assert out.agg(F.sum("cnt")).first()[0] == 2 * files.count()
    assert out.filter((F.col("window_end") - F.col("window_start")) != F.expr("INTERVAL 2 HOURS")).count() == 0


# ------------------------------------------------------------- replays
def _log(spark, rows):
    return spark.createDataFrame(rows, "log_id long, task_id long, id_2 string, message string, error_sysdate timestamp_ntz")


def _at(minutes):
    import datetime as dt
    return dt.datetime(2024, 1, 10, 12) + dt.timedelta(minutes=minutes)


def test_open_windows_go_on_over_a_restart(spark):
    """A session, a span and an hour that a restart cuts in two come out whole, once."""
    from opsight.streaming.streams import closing_rows, replay, stream_session_pivot, stream_start_end
    first = _log(spark, [(1, 7, "a", "Task: TF_X", _at(0)), (2, 7, "a", "x", _at(20)), (3, 8, "b", "Task: TF_Y", _at(5))])
    second = _log(spark, [(4, 7, "a", "END: File Task Register", _at(45)), (5, 7, "a", "x", _at(75)), (6, 8, "b", "END: File Task Register", _at(24 * 60 + 6))])
    whole = first.unionByName(second)
    sessions = replay(spark, "t-sessions", [first, second.unionByName(closing_rows(whole, "error_sysdate"))], stream_session_pivot)
    want = {(7, _at(0), _at(105)), (8, _at(5), _at(35)), (8, _at(24 * 60 + 6), _at(24 * 60 + 36))}   # half an hour apart is together
    assert {(r.task_id, r.session_start, r.session_end) for r in sessions.rows.collect()} == want
    assert {tuple(r) for r in stream_session_pivot(whole).collect()} == {tuple(r) for r in sessions.rows.collect()}
    closing = [{"message": m, "id_2": "z"} for m in ("Task: TF_C", "END: File Task Register")]
    spans = replay(spark, "t-spans", [first, second.unionByName(closing_rows(whole, "error_sysdate", *closing))], stream_start_end)
    assert {(r.id_2, r.start_log_id, r.end_log_id) for r in spans.rows.collect()} == {("a", 1, 4), ("b", 3, None)}


def test_a_replay_leaves_only_its_rows(spark):
    from opsight.session import checkpoint_dir
    from opsight.streaming.streams import closing_rows, replay, stream_hourly
    log = _log(spark, [(k, 1, "a", "x", _at(10 * k)) for k in range(60)])
    run = replay(spark, "t-clean", [log.filter("log_id < 30"), log.filter("log_id >= 30").unionByName(closing_rows(log, "error_sysdate"))],
                 lambda d: stream_hourly(d, "error_sysdate"))
    assert sorted(tuple(r) for r in run.rows.collect()) == sorted(tuple(r) for r in stream_hourly(log, "error_sysdate").collect())
    assert run.rows_in == 61 and run.dropped == 0
    import os
    base = os.path.normpath("/" + run.rows.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file:").lstrip("/"))
    assert base.startswith(checkpoint_dir(spark).removeprefix("file:").rstrip("/")) and os.listdir(base) == ["rows"]


def test_late_rows_are_counted_from_progress(spark):
    from opsight.streaming.streams import closing_rows, late_rows, replay, stream_hourly
    first = _log(spark, [(k, 1, "a", "x", _at(60 * k)) for k in range(10)])
    # Watermark after the first run: 9 h - 2 h.  Windows that end by then are closed: 7 late rows, in 3 windows.
    second = _log(spark, [(100 + k, 1, "a", "x", _at(60 * h + 3 * k)) for k, h in enumerate([0, 0, 0, 3, 3, 6, 6, 7, 8, 20])])
    run = replay(spark, "t-late", [first, second.unionByName(closing_rows(second, "error_sysdate"))], lambda d: stream_hourly(d, "error_sysdate"))
    assert tuple(late_rows(run).first()) == (20, 13, 7, True)


def test_a_hot_task_is_merged_before_the_shuffle(spark):
    """Streams merge sessions inside each partition; a batch groups by slots first: a third of the log is a row a slot."""
    from pyspark.sql import functions as F
    from opsight.streaming.streams import closing_rows, replay, stream_session_pivot
    log = spark.range(0, 9000, numPartitions=6).select(
        F.col("id").alias("log_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("task_id"), F.lit("k").alias("id_2"), F.lit("x").alias("message"),
        F.expr("timestampadd(SECOND, CAST(id * 3 AS INT), TIMESTAMP_NTZ'2024-01-10 00:00:00')").alias("error_sysdate"))
    run = replay(spark, "t-hot", [log, closing_rows(log, "error_sysdate")], stream_session_pivot)
    head, _, below = run.plan.partition("StateStoreRestore")
    assert "MergingSessions" in below.split("Exchange")[1], run.plan
    batch = stream_session_pivot(log)
    assert sorted(tuple(r) for r in run.rows.collect()) == sorted(tuple(r) for r in batch.collect())
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "MergingSessions" not in plan
    assert batch.filter("task_id = 7").agg(F.sum("logs_cnt")).first()[0] == log.filter("task_id = 7").count()


def test_dedup_does_not_depend_on_arrival(spark):
    import datetime as dt
    from opsight.streaming.streams import closing_rows, replay
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [("a", day(1), 1), ("a", day(1, 20), 2), ("a", day(2, 10), 3), ("a", day(5), 4), ("b", day(3), 5), ("b", day(3), 6), ("c", day(4, 23), 7), ("c", day(6), 8), ("d", day(2), 9), ("d", day(3), 10)]
    schema = "short_filename string, register_datetime timestamp_ntz, file_key long"
    df = spark.createDataFrame(rows, schema)
    want = [("a", day(1), 1), ("a", day(5), 4), ("b", day(3), 5), ("c", day(4, 23), 7), ("c", day(6), 8), ("d", day(2), 9)]
    assert sorted(tuple(r) for r in stream_dedup(df).collect()) == want
    # The later rows come first, within the allowed lateness.
    parts = [df.filter("file_key IN (2, 3, 6, 5)"), df.filter("file_key NOT IN (2, 3, 6, 5)")]
    got = replay(spark, "t-dedup", [parts[0], parts[1].unionByName(closing_rows(df, "register_datetime"))], lambda d: stream_dedup(d, lateness="3 days"))
    assert sorted(tuple(r) for r in got.rows.collect()) == want


def test_a_restart_does_not_meet_the_keys_that_were_closed(spark):
    from pyspark.sql import functions as F
    from opsight.streaming.streams import closing_rows, replay
    df = spark.range(20000).selectExpr("concat('f', id) AS short_filename", "id AS file_key",
                                       "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 20 AS INT)) AS register_datetime")
    first = F.col("file_key") % 20 < 10
    run = replay(spark, "t-closed", [df.filter(first), df.filter(~first).unionByName(closing_rows(df, "register_datetime"))], stream_dedup, partitions=2)
    assert run.rows.count() == 20000
    # Bytes of the state's files after each trigger: rows, closed windows, rows, closed windows.
    size = [p["stateOperators"][0]["customMetrics"].get("rocksdbSstFileSize", 0) for p in run.progress]
    assert len(size) == 4 and size[1] < size[0] / 2 and size[3] < size[2] / 20


def test_islands_of_empty_and_null_clocks(spark):
    from opsight.streaming.streams import stream_session_pivot
    assert stream_session_pivot(_log(spark, [])).count() == 0
    assert stream_session_pivot(_log(spark, [(1, 1, "a", "x", None)])).count() == 0
    got = stream_session_pivot(_log(spark, [(1, None, "a", "x", _at(0)), (2, None, "a", "x", _at(29)), (3, None, "a", "x", _at(60))])).collect()
    assert [(r.task_id, r.logs_cnt) for r in sorted(got)] == [(None, 2), (None, 1)]
