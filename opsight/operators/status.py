"""Run status, queue and alerts.

Rollups (R10-R12) are computed from *mergeable partials*: runs are first
aggregated per (task_id, grouping keys) - map-side combine absorbs a hot
task - and only the small partial table is joined to the task dimension and
merged again.  Averages are sums over counts, so the merge is exact.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions import duck as D
from opsight.functions import texts as T
from opsight.functions.expr import (
    BUCKET_STATUSES, OPEN_STATUSES, cnt_if, day_of, days_ago, hms_text, interval_between, interval_text, key_to_date,
    micros_between, num_text, numtodsinterval, round_duration, round_rate, secs_between, ts_lit,
)
from opsight.functions import patterns as P
from opsight.plans.registry import query
from opsight.session import cut_lineage
from opsight.sources.fixtures import AS_OF_FILES, AS_OF_RUNS, fixtures

TS_FMT = "yyyyMMdd HH:mm:ss"


def _ts_text(c: str) -> Column:
    return F.date_format(c, TS_FMT)


def _my_dtk(b_key="b_dw_date_key") -> Column:
    return F.coalesce(F.col(b_key).cast("string"), F.col("diy_parameter"), F.lit("_"))


def _with_batches(runs: DataFrame, batches: DataFrame, copied: bool = False) -> DataFrame:
    """Runs left-joined to their batch (and the batch it was copied from)."""
    b = batches.select(F.col("batch_id"), F.col("dw_date_key").alias("b_dw_date_key"),
                       F.col("copied_batch_id").alias("b_copied_batch_id"))
    out = runs.join(b, "batch_id", "left")
    if copied:
        c = batches.select(F.col("batch_id").alias("b_copied_batch_id"),
                           F.col("dw_date_key").alias("c_dw_date_key"),
                           F.col("copied_batch_id").alias("c_copied_batch_id"))
        out = out.join(c, "b_copied_batch_id", "left")
    return out


# --------------------------------------------------------------------- R1
def failed_run_detail(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Failed runs with task attributes and formatted times, newest first."""
    t = tasks.select("task_id", "task_business_area", "task_technical_area", "task_target_type")
    j = runs.filter(F.col("run_status") == "FAILED").join(t, "task_id")
    return j.select(
        "run_status", "task", "rows_loaded", _ts_text("start_date").alias("start_date"),
        _ts_text("end_date").alias("end_date"), "batch_id", "task_id", "run_id", "rows_error",
        "diy_parameter", "task_business_area", "task_technical_area", "task_target_type",
        F.col("start_date").alias("_s"),
    ).orderBy(F.col("_s").desc_nulls_first(), F.col("task_business_area").asc_nulls_last()).drop("_s")


@query("failed_run_detail", "R1", f"""
SELECT a.run_status, a.task, a.rows_loaded, {D.ts_text('a.start_date')} AS start_date,
       {D.ts_text('a.end_date')} AS end_date, a.batch_id, a.task_id, a.run_id, a.rows_error, a.diy_parameter,
       b.task_business_area, b.task_technical_area, b.task_target_type
FROM fx_runs a JOIN fx_tasks b ON a.task_id = b.task_id
WHERE a.run_status IN ('FAILED')
""")
def q_failed_run_detail(spark, sf):
    fx = fixtures(spark, sf)
    return failed_run_detail(fx.runs, fx.tasks)


# --------------------------------------------------------------------- R2
def failed_run_alerts(runs: DataFrame) -> DataFrame:
    """One alert sentence per task with failed runs, most failures first."""
    g = runs.filter(F.col("run_status") == "FAILED").groupBy("task", "run_status") \
        .agg(F.count(F.lit(1)).alias("no_failed")).filter(F.col("no_failed") > 0)
    return g.select("task", F.concat_ws("", F.lit(T.HAS), F.col("no_failed").cast("string"),
                                        F.lit(T.FAILED_RUNS_IN_RT_RUNS)).alias("alert_text"),
                    "no_failed").orderBy(F.col("no_failed").desc(), "task").drop("no_failed")


@query("failed_run_alerts", "R2", """
SELECT task, 'Has ' || CAST(no_failed AS VARCHAR) || ' Failed runs in rt runs ' AS alert_text
FROM (SELECT task, run_status, count(*) AS no_failed FROM fx_runs WHERE run_status = 'FAILED'
      GROUP BY task, run_status HAVING count(*) > 0)
""")
def q_failed_run_alerts(spark, sf):
    return failed_run_alerts(fixtures(spark, sf).runs)


# --------------------------------------------------------------------- R3
def queue_backlog(runs: DataFrame, tasks: DataFrame, batches: DataFrame, min_size: int = 5) -> DataFrame:
    """Open runs per task (queue size, source and own date keys, run ids), queues above ``min_size``."""
    r = runs.filter(F.col("run_status").isin(*OPEN_STATUSES))
    rb = _with_batches(r, batches, copied=True).select(
        "task_id", "run_id", F.col("c_dw_date_key").alias("src_dtk"), _my_dtk().alias("my_dtk"))
    agg = rb.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("queue_size"), F.min("src_dtk").alias("min_src_dtk"),
        F.max("src_dtk").alias("max_src_dtk"), F.min("run_id").alias("min_run_id"),
        F.min("my_dtk").alias("min_my_dtk"), F.max("my_dtk").alias("max_my_dtk"),
        F.max("run_id").alias("max_run_id")).filter(F.col("queue_size") > min_size)
    j = agg.join(tasks.select("task_id", "is_runnable", "task"), "task_id")
    return j.select("task_id", "is_runnable", "task", "queue_size", "min_src_dtk", "max_src_dtk",
                    "min_run_id", "min_my_dtk", "max_my_dtk", "max_run_id") \
        .orderBy(F.col("queue_size").desc(), "task_id")


@query("queue_backlog", "R3", """
SELECT * FROM (
  SELECT x.task_id, x.is_runnable, x.task, count(*) AS queue_size, min(c.dw_date_key) AS min_src_dtk,
         max(c.dw_date_key) AS max_src_dtk, min(a.run_id) AS min_run_id,
         min(coalesce(CAST(b.dw_date_key AS VARCHAR), a.diy_parameter, '_')) AS min_my_dtk,
         max(coalesce(CAST(b.dw_date_key AS VARCHAR), a.diy_parameter, '_')) AS max_my_dtk,
         max(a.run_id) AS max_run_id
  FROM fx_runs a JOIN fx_tasks x ON a.task_id = x.task_id
  LEFT JOIN fx_batches b ON a.batch_id = b.batch_id
  LEFT JOIN fx_batches c ON b.copied_batch_id = c.batch_id
  WHERE a.run_status IN ('FAILED', 'RUNABLE', 'RUNNING', 'PENDING', 'WAITING')
  GROUP BY x.task_id, x.is_runnable, x.task)
WHERE queue_size > 5
""")
def q_queue_backlog(spark, sf):
    fx = fixtures(spark, sf)
    return queue_backlog(fx.runs, fx.tasks, fx.batches, 5)


# --------------------------------------------------------------------- R4
def long_running(runs: DataFrame, as_of: dt.datetime, min_days: float = 0.1) -> DataFrame:
    """Runs RUNNING since more than ``min_days`` before ``as_of``."""
    r = runs.filter((F.col("run_status") == "RUNNING") & (F.col("start_date") < days_ago(as_of, min_days)))
    return r.select(
        F.date_format(ts_lit(as_of), TS_FMT).alias("curr_dt"), "run_status", "task", "rows_loaded",
        _ts_text("start_date").alias("start_date"), _ts_text("end_date").alias("end_date"),
        "batch_id", "task_id", "run_id", "rows_error", "diy_parameter",
    ).orderBy(F.col("start_date").desc(), F.col("run_id").desc())


@query("long_running", "R4", f"""
SELECT '20240131 00:00:00' AS curr_dt, run_status, task, rows_loaded, {D.ts_text('start_date')} AS start_date,
       {D.ts_text('end_date')} AS end_date, batch_id, task_id, run_id, rows_error, diy_parameter
FROM fx_runs WHERE run_status IN ('RUNNING') AND start_date < TIMESTAMP '2024-01-30 21:36:00'
""")
def q_long_running(spark, sf):
    return long_running(fixtures(spark, sf).runs, AS_OF_RUNS, 0.1)


# --------------------------------------------------------------------- R5
def _status_rank() -> Column:
    s = F.col("run_status")
    return (F.when(s == "RUNNING", 1).when(s.isin("FAILED", "WAITING", "PENDING"), 2)
             .when(s == "RUNABLE", 3).otherwise(4))


def wait_time_topn(runs: DataFrame, batches: DataFrame, as_of: dt.datetime, task_likes=(),
                   task_in=(), not_like: str = P.RULE_TASKS, n: int = 6) -> DataFrame:
    """Waiting time of the selected tasks' runs; status-ranked, first ``n``."""
    conds = [F.col("task").like(p) for p in task_likes]
    if task_in:
        conds.append(F.col("task").isin(*task_in))
    r = runs.filter(reduce(lambda a, b: a | b, conds) & ~F.col("task").like(not_like))
    w = F.col("run_status").isin("WAITING", "RUNABLE")
    s = secs_between("start_date", ts_lit(as_of))
    out = _with_batches(r, batches).select(
        _my_dtk().alias("my_dtk"), "run_status", "task", "rows_loaded",
        "start_date", "end_date",
        F.when(w, F.round(s / 60, 0)).cast("long").alias("mins_waiting"),
        F.when(w, F.round(s / 3600, 0)).cast("long").alias("hours_waiting"),
        "batch_id", "task_id", "run_id", "rows_error", "diy_parameter")
    return out.orderBy(_status_rank(), F.col("start_date").desc_nulls_first(), F.col("run_id").desc()).limit(n)


@query("wait_time_topn", "R5", f"""
SELECT coalesce(CAST(b.dw_date_key AS VARCHAR), a.diy_parameter, '_') AS my_dtk, a.run_status, a.task,
       a.rows_loaded, a.start_date, a.end_date,
       CASE WHEN a.run_status IN ('WAITING', 'RUNABLE') THEN CAST(round({D.secs('a.start_date', D.RUNS_CLOCK)} / 60, 0) AS BIGINT) END AS mins_waiting,
       CASE WHEN a.run_status IN ('RUNABLE', 'WAITING') THEN CAST(round({D.secs('a.start_date', D.RUNS_CLOCK)} / 3600, 0) AS BIGINT) END AS hours_waiting,
       a.batch_id, a.task_id, a.run_id, a.rows_error, a.diy_parameter
FROM fx_runs a LEFT JOIN fx_batches b ON a.batch_id = b.batch_id
WHERE (a.task LIKE 'Customer#%' OR a.task IN ('Customer#000000012')) AND a.task NOT LIKE '%RULE%'
ORDER BY CASE WHEN a.run_status = 'RUNNING' THEN 1 WHEN a.run_status IN ('FAILED', 'WAITING', 'PENDING') THEN 2
              WHEN a.run_status = 'RUNABLE' THEN 3 ELSE 4 END, a.start_date DESC NULLS FIRST, a.run_id DESC
LIMIT 6
""")
def q_wait_time_topn(spark, sf):
    fx = fixtures(spark, sf)
    return wait_time_topn(fx.runs, fx.batches, AS_OF_RUNS, ("Customer#%",), ("Customer#000000012",))


# --------------------------------------------------------------------- R6
def recent_run_profile(runs: DataFrame, as_of: dt.datetime, like_a: str, like_b: str,
                       n: int = 32, literal_precedence: bool = True) -> DataFrame:
    """Last ``n`` runs of two tasks: minutes and days behind the parameter date.

    ``literal_precedence`` keeps the script's ``a OR b AND closed`` (the
    status filter binds only to the second pattern).
    """
    a, b = F.col("task").like(like_a), F.col("task").like(like_b)
    closed = F.col("run_status").isin("CLOSED")
    cond = (a | (b & closed)) if literal_precedence else ((a | b) & closed)
    end_or_now = F.coalesce(F.col("end_date"), ts_lit(as_of))
    r = runs.filter(cond).select(
        "task", "rows_loaded", "batch_id",
        F.floor(secs_between("start_date", end_or_now) / 60, F.lit(1)).cast("double").alias("mins"),
        F.datediff(F.to_date("end_date"), key_to_date("diy_parameter")).alias("days_behind"),
        "end_date", "diy_parameter", "start_date", "run_id")
    top = r.orderBy(F.col("start_date").desc_nulls_first(), F.col("run_id").desc()).limit(n)
    return top.orderBy(F.col("diy_parameter").desc_nulls_first(), F.col("run_id").desc()) \
        .drop("start_date", "run_id")


@query("recent_run_profile", "R6", f"""
SELECT task, rows_loaded, batch_id, mins, days_behind, end_date, diy_parameter FROM (
  SELECT task, rows_loaded, batch_id,
         CAST(trunc({D.secs('start_date', f'coalesce(end_date, {D.RUNS_CLOCK})')} / 60, 1) AS DOUBLE) AS mins,
         CAST(date_diff('day', CAST(try_strptime(diy_parameter, '%Y%m%d') AS DATE), CAST(end_date AS DATE)) AS INTEGER) AS days_behind,
         end_date, diy_parameter, start_date, run_id
  FROM fx_runs
  WHERE (task LIKE 'Customer#000000017') OR (task LIKE 'Customer#000000029' AND run_status IN ('CLOSED'))
  ORDER BY start_date DESC NULLS FIRST, run_id DESC LIMIT 32)
""")
def q_recent_run_profile(spark, sf):
    return recent_run_profile(fixtures(spark, sf).runs, AS_OF_RUNS, "Customer#000000017", "Customer#000000029")


# --------------------------------------------------------------------- R8
def range_run_stats(ranges: DataFrame) -> DataFrame:
    """Per run: range count, duration and rows-per-second spread."""
    s = secs_between("start_date", "end_date")
    rps = F.try_divide(F.col("rows_loaded").cast("double"), F.nullif(s, F.lit(0.0)))
    us = micros_between("start_date", "end_date").cast("decimal(38,0)")
    mins = round_duration("start_date", "end_date", 60, 2)
    rps_r = round_rate("rows_loaded", "start_date", "end_date")
    return ranges.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("range_cnt"),
        F.min(mins).alias("min_duration"),
        F.round(F.sum(us) / (F.count(us) * F.lit(60_000_000)), 2).cast("double").alias("avg_duration"),
        F.max(mins).alias("max_duration"),
        F.min(rps_r).alias("min_rows_persec"),
        F.round(F.avg(rps), 0).alias("avg_rows_persec"),
        F.max(rps_r).alias("max_rows_persec"))


def _r8_sql(src: str = "fx_ranges") -> str:
    s = D.secs("start_date", "end_date")
    rps = f"(rows_loaded / nullif({s}, 0))"
    mins = D.round_duration("start_date", "end_date", 60, 2)
    rr = D.round_rate("rows_loaded", "start_date", "end_date")
    us = "date_diff('microsecond', start_date, end_date)"
    avg = f"CAST((sum({us}) * 200 + count({us}) * 60000000) // (count({us}) * 120000000) AS DOUBLE) / 100"
    return f"""SELECT run_id, count(*) AS range_cnt, min({mins}) AS min_duration,
        {avg} AS avg_duration, max({mins}) AS max_duration,
        min({rr}) AS min_rows_persec, round(avg({rps}), 0) AS avg_rows_persec,
        max({rr}) AS max_rows_persec
      FROM {src} GROUP BY run_id"""


@query("range_run_stats", "R8", _r8_sql())
def q_range_run_stats(spark, sf):
    return range_run_stats(fixtures(spark, sf).ranges)


# --------------------------------------------------------------------- R9
def day_duration(runs: DataFrame, batches: DataFrame, first_tasks, last_task: str, key,
                 as_of: dt.datetime) -> DataFrame:
    """From the first start of the opening tasks to the end of the closing task."""
    key = key if isinstance(key, Column) else F.lit(str(key))
    return _day_rows(_keyed_runs(runs, batches, key), first_tasks, last_task, key, as_of)


def _keyed_runs(runs: DataFrame, batches: DataFrame, key: Column, copied: bool = False) -> DataFrame:
    """Non-cancelled runs of one process date with their batch (and, for the board, its copied batch).

    A run's date is its batch's, or its own parameter where the batch has none:
    the batches of that date are found first, so only runs that can qualify are
    joined to a batch.
    """
    live = runs.filter(F.col("run_status") != "CANCELLED")
    dated = batches.select("batch_id", F.col("dw_date_key").cast("string").alias("__key"))
    own = live.filter(F.coalesce("diy_parameter", F.lit("_")) == key) \
        .join(dated.filter(F.col("__key").isNotNull()).select("batch_id"), "batch_id", "left_anti")
    by_batch = live.join(dated.filter(F.col("__key") == key).select("batch_id").distinct(), "batch_id", "left_semi")
    return _with_batches(own.unionByName(by_batch), batches, copied=copied)


def _day_rows(rb: DataFrame, first_tasks, last_task: str, key: Column, as_of: dt.datetime) -> DataFrame:
    start = rb.filter(F.col("task").isin(*first_tasks)).agg(F.min("start_date").alias("day_start"))
    end = rb.filter(F.col("task") == last_task).select(F.col("end_date").alias("day_end"))
    # ``start`` is one global-aggregate row: broadcasting it is size-bounded.
    j = end.crossJoin(F.broadcast(start.filter(F.col("day_start").isNotNull())))
    stop = F.coalesce(F.col("day_end"), ts_lit(as_of))
    return j.select(
        F.lit(T.DAY_DURATION).alias("task"), key.alias("my_dtk"),
        F.when(F.col("day_end").isNull(), F.lit("RUNNING")).otherwise(F.lit("CLOSED")).alias("run_status"),
        F.round(secs_between("day_start", stop), 6).alias("duration_sec"),
        _ts_text("day_start").alias("start_date"), _ts_text("day_end").alias("end_date"))


R9_FIRST = ("Customer#000000010", "Customer#000000011", "Customer#000000012", "Customer#000000014")
R9_LAST = "Customer#000000020"
R9_KEY_TASK = "Customer#000000003"


def _r9_sql(key_sql: str) -> str:
    openers = ", ".join(f"'{t}'" for t in R9_FIRST)
    return f"""
WITH wanted AS (SELECT {key_sql} AS my_dtk),
dated AS (
  SELECT r.task, r.start_date, r.end_date
  FROM fx_runs r LEFT JOIN fx_batches USING (batch_id) CROSS JOIN wanted
  WHERE r.run_status <> 'CANCELLED' AND ifnull(ifnull(fx_batches.dw_date_key::VARCHAR, r.diy_parameter), '_') = wanted.my_dtk
), opening AS (
  SELECT min(start_date) AS day_start FROM dated WHERE task IN ({openers}) HAVING min(start_date) IS NOT NULL
)
SELECT 'DAY DURATION' AS task, my_dtk, if(end_date IS NULL, 'RUNNING', 'CLOSED') AS run_status,
       round({D.secs('day_start', f'ifnull(end_date, {D.RUNS_CLOCK})')}, 6) AS duration_sec,
       {D.ts_text('day_start')} AS start_date, {D.ts_text('end_date')} AS end_date
FROM dated CROSS JOIN opening CROSS JOIN wanted WHERE task = '{R9_LAST}'"""


_R9_KEY_SQL = f"(SELECT CAST(max_key AS VARCHAR) FROM fx_tasks WHERE task = '{R9_KEY_TASK}')"


def _key_of_task(tasks: DataFrame, task: str) -> Column:
    return tasks.filter(F.col("task") == task).select(F.max("max_key").cast("string")).scalar()


@query("day_duration", "R9", _r9_sql(_R9_KEY_SQL))
def q_day_duration(spark, sf):
    fx = fixtures(spark, sf)
    return day_duration(fx.runs, fx.batches, R9_FIRST, R9_LAST, _key_of_task(fx.tasks, R9_KEY_TASK),
                        AS_OF_RUNS)


# --------------------------------------------------------------------- R7
def run_board(runs: DataFrame, tasks: DataFrame, batches: DataFrame, ranges: DataFrame,
              sections: DataFrame, key, as_of: dt.datetime, first_tasks, last_task: str) -> DataFrame:
    """One row per run of the critical path for ``key``, plus the day row.

    ``sections``: (task, section, section_rank) - the two CASE ladders of the
    script as one table; unlisted tasks are not on the board.
    """
    key = key if isinstance(key, Column) else F.lit(str(key))
    # Runs of the date are found once, for the board and for its day row, and written to the shared folder.
    closing = [*first_tasks, last_task]
    named = sections.select("task").union(runs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in closing])))).distinct()
    keyed = cut_lineage(_keyed_runs(runs.join(named, "task", "left_semi"), batches, key, copied=True))
    rb = keyed.join(sections, "task")
    # Ranges of the board's runs only are aggregated.
    stats = range_run_stats(ranges.join(rb.select("run_id").distinct(), "run_id", "left_semi"))
    t = tasks.select("task_id", "task_business_area")
    j = rb.join(t, "task_id", "left").join(stats, "run_id", "left")
    cols_null = ["src_dtk", "rows_loaded", "run_id", "batch_id", "copied_batch_id", "task_id", "rows_error",
                 "diy_parameter", "direct_exec_sql", "task_business_area", "range_cnt", "avg_dur", "max_dur", "min_rps",
                 "avg_rps", "max_rps"]
    board = j.select(
        "section", "section_rank", F.col("c_dw_date_key").alias("src_dtk"), _my_dtk().alias("my_dtk"),
        "run_status", "task", F.round(secs_between("start_date", "end_date"), 6).alias("duration_sec"),
        _ts_text("start_date").alias("start_date"), _ts_text("end_date").alias("end_date"),
        "rows_loaded", "run_id", "batch_id", F.col("c_copied_batch_id").alias("copied_batch_id"),
        "task_id", "rows_error", "diy_parameter", "direct_exec_sql", "task_business_area", "range_cnt",
        F.col("avg_duration").alias("avg_dur"), F.col("max_duration").alias("max_dur"),
        F.col("min_rows_persec").alias("min_rps"), F.col("avg_rows_persec").alias("avg_rps"),
        F.col("max_rows_persec").alias("max_rps"))
    day = _day_rows(keyed, first_tasks, last_task, key, as_of)
    # One global-aggregate row: a bounded broadcast.
    day = day.crossJoin(F.broadcast(_day_section(sections)))
    for c in cols_null:
        day = day.withColumn(c, F.lit(None).cast(board.schema[c].dataType))
    out = board.unionByName(day.select(board.columns))
    return out.orderBy(F.col("section_rank").asc_nulls_last(), "task", F.col("run_id").desc_nulls_last())


def _day_section(sections: DataFrame) -> DataFrame:
    """Section and rank of the synthetic day row (rank 0 when unlisted)."""
    s = sections.filter(F.col("task") == "DAY DURATION")
    return s.agg(F.max("section").alias("section"),
                 F.coalesce(F.max("section_rank"), F.lit(0.0)).alias("section_rank"))


def sections_from_tasks(tasks: DataFrame) -> DataFrame:
    """Board layout used by the registered query: every task, sectioned by area."""
    secs = tasks.select(
        "task",
        F.concat_ws(".", F.substring("task_business_area", 1, 1), (F.col("task_id") % 5).cast("string"),
                    F.lit("A")).alias("section"),
        ((F.col("task_id") % 44) + F.when(F.col("task_id") % 10 == 1, 0.1).otherwise(0.0)).cast("double")
        .alias("section_rank"))
    day = tasks.sparkSession.range(1).select(F.lit("DAY DURATION").alias("task"), F.lit("6.1.A").alias("section"),
                                             F.lit(0.0).alias("section_rank"))
    return secs.unionByName(day)


@query("run_board", "R7", f"""
WITH wanted AS (SELECT {_R9_KEY_SQL} AS day_key),
place AS (
  SELECT task, concat_ws('.', task_business_area[1], (task_id % 5)::VARCHAR, 'A') AS section,
         (task_id % 44 + if(task_id % 10 = 1, 0.1, 0))::DOUBLE AS section_rank
  FROM fx_tasks
), spread AS ({_r8_sql()}),
origin AS (SELECT own.batch_id, own.dw_date_key::VARCHAR AS own_key, source.dw_date_key AS src_dtk, source.copied_batch_id
           FROM fx_batches AS own LEFT JOIN fx_batches AS source ON source.batch_id = own.copied_batch_id),
of_day AS (
  SELECT run.*, ifnull(own_key, ifnull(diy_parameter, '_')) AS my_dtk, src_dtk, copied_batch_id
  FROM fx_runs AS run LEFT JOIN origin USING (batch_id)
  WHERE run_status <> 'CANCELLED' AND ifnull(own_key, ifnull(diy_parameter, '_')) = (FROM wanted)
), listed AS (
  SELECT place.section, section_rank, src_dtk, my_dtk, run_status, of_day.task,
         round({D.secs('start_date', 'end_date')}, 6) AS duration_sec, {D.ts_text('start_date')} AS start_date,
         {D.ts_text('end_date')} AS end_date, rows_loaded, run_id, batch_id, copied_batch_id, of_day.task_id, rows_error,
         diy_parameter, direct_exec_sql, owner.task_business_area, range_cnt, avg_duration AS avg_dur, max_duration AS max_dur,
         min_rows_persec AS min_rps, avg_rows_persec AS avg_rps, max_rows_persec AS max_rps
  FROM of_day INNER JOIN place USING (task)
  LEFT JOIN (SELECT task_id, task_business_area FROM fx_tasks) AS owner USING (task_id) LEFT JOIN spread USING (run_id)
)
FROM listed
UNION ALL BY NAME
SELECT '6.1.A' AS section, 0.0::DOUBLE AS section_rank, my_dtk, run_status, task, duration_sec, start_date, end_date
FROM ({_r9_sql(_R9_KEY_SQL)})
""")
def q_run_board(spark, sf):
    fx = fixtures(spark, sf)
    return run_board(fx.runs, fx.tasks, fx.batches, fx.ranges, sections_from_tasks(fx.tasks),
                     _key_of_task(fx.tasks, R9_KEY_TASK), AS_OF_RUNS, R9_FIRST, R9_LAST)


# --------------------------------------------------------------------- R10-R13
def _status_partials(runs: DataFrame, keys) -> DataFrame:
    """Mergeable per-key partial aggregates of run status measures."""
    s = F.col("run_status")
    micros = micros_between("start_date", "end_date")     # integers: the sum does not depend on the order
    done = s.isin("CLOSED", "SUCCESS")
    last_dt = F.when(done, F.coalesce(F.col("diy_parameter").cast("long"),
                                      F.date_format("end_date", "yyyyMMdd").cast("long")))
    return runs.groupBy(*keys).agg(
        cnt_if(s == "RUNABLE").alias("queue"), cnt_if(s == "RUNNING").alias("busy"),
        cnt_if(done).alias("done"), cnt_if(s == "FAILED").alias("fail"),
        cnt_if(~s.isin(*BUCKET_STATUSES)).alias("other"),
        cnt_if(s.isin("RUNABLE", "FAILED")).alias("_pend"), cnt_if(s.isin(*BUCKET_STATUSES)).alias("_tot"),
        F.sum("rows_loaded").alias("rows_loaded"), F.count("rows_loaded").alias("_rows_n"),
        F.sum("rows_error").alias("rows_err"), F.sum("rows_inserted").alias("rows_inserted"),
        F.sum("rows_updated").alias("rows_updated"),
        F.sum(micros).alias("_micros"), F.count(micros).alias("_secs_n"),
        F.max(last_dt).alias("last_run_dt"), F.max("end_date").alias("_max_end"))


_SUMS = ("queue", "busy", "done", "fail", "other", "_pend", "_tot", "rows_loaded", "_rows_n", "rows_err",
         "rows_inserted", "rows_updated", "_micros", "_secs_n")


def _merge_partials(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS],
                                 F.max("last_run_dt").alias("last_run_dt"), F.max("_max_end").alias("_max_end"))


# Row measures the report prints with TO_CHAR(n, '999,999,999,999').
ROLLUP_TEXT = ("rows_loaded", "rows_err", "avg_rows", "estimated_rows")
HOURLY_TEXT = ("rows_err", "estimated_rows")


def _status_measures(df: DataFrame, text_cols=ROLLUP_TEXT) -> list[Column]:
    avg_rows = F.round(F.col("rows_loaded") / F.nullif(F.col("_rows_n"), F.lit(0)))
    avg_secs = F.col("_micros") / F.nullif(F.col("_secs_n"), F.lit(0)) / F.lit(1_000_000.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    fmt = lambda v, c: (num_text(v) if c in text_cols else v.cast("long")).alias(c)
    return [zero("queue"), zero("busy"), zero("done"), zero("fail"), zero("other"),
            fmt(F.col("rows_loaded"), "rows_loaded"), fmt(F.col("rows_err"), "rows_err"),
            fmt(avg_rows, "avg_rows"), fmt(avg_rows * F.col("queue"), "estimated_rows"),
            hms_text(avg_secs).alias("average_duration"),
            hms_text(avg_secs * F.col("queue"), "h").alias("estimated_load_duration"),
            (F.lit(100) - F.round(F.col("_pend") / F.nullif(F.col("_tot"), F.lit(0)) * 100, 2))
            .cast("double").alias("percentage_completed"),
            F.col("rows_inserted").cast("long").alias("rows_inserted"),
            F.col("rows_updated").cast("long").alias("rows_updated")]


def task_status_rollup(tasks: DataFrame, runs: DataFrame, like: str = P.S2C_TASKS,
                       not_like: str = P.PATTERN_TASKS) -> DataFrame:
    """Per task: queue / busy / done / fail / other, rows, durations, % complete."""
    t = tasks.filter(F.col("task").like(like) & ~F.col("task").like(not_like))
    # Partials per id, merged by the report's own keys: ids that share them are one row.
    keys = ["task_type", "task", "is_runnable", "parameter_type", "task_business_area", "task_technical_area",
            "max_file_load_concurrency"]
    keys = [c for c in keys if c in tasks.columns]
    j = _merge_partials(t.join(_status_partials(runs, ["task_id"]), "task_id", "left"), keys)
    out = j.select(
        "task_type", "task", F.col("is_runnable").alias("runable"),
        F.col("max_file_load_concurrency").alias("concurncy"), "last_run_dt",
        F.date_format("_max_end", "HH:mm:ss").alias("last_run_tm"), *_status_measures(j))
    return out.orderBy(F.col("busy").desc(), F.col("queue").desc(), F.col("last_run_dt").asc_nulls_last())


def _rollup_sql_measures(text_cols=ROLLUP_TEXT) -> str:
    """The measures over columns of fx_runs; a task without runs has one row of NULLs."""
    micros = "date_diff('microsecond', start_date, end_date)"
    mean = f"(sum({micros})::DOUBLE / nullif(count({micros}), 0) / 1000000)"
    waiting = "count(*) FILTER (run_status = 'RUNABLE')"
    rows = "round(sum(rows_loaded) / nullif(count(rows_loaded), 0))"
    shown = lambda e, c: (D.num_text(e) if c in text_cols else f"({e})::BIGINT") + f" AS {c}"
    return f"""
      {waiting} AS queue,
      count(*) FILTER (run_status = 'RUNNING') AS busy,
      count(*) FILTER (run_status IN ('SUCCESS', 'CLOSED')) AS done,
      count(*) FILTER (run_status = 'FAILED') AS fail,
      count(*) FILTER (run_status NOT IN ('SUCCESS', 'RUNNING', 'RUNABLE', 'FAILED', 'CLOSED')) AS other,
      {shown("sum(rows_loaded)", "rows_loaded")},
      {shown("sum(rows_error)", "rows_err")},
      {shown(rows, "avg_rows")},
      {shown(f"{rows} * {waiting}", "estimated_rows")},
      {D.hms(mean)} AS average_duration,
      {D.hms(f"{mean} * {waiting}", "h")} AS estimated_load_duration,
      (100 - round(count(*) FILTER (run_status IN ('FAILED', 'RUNABLE'))
        / nullif(count(*) FILTER (run_status IN ('SUCCESS', 'RUNNING', 'RUNABLE', 'FAILED', 'CLOSED')), 0) * 100, 2))::DOUBLE
        AS percentage_completed,
      sum(rows_inserted)::BIGINT AS rows_inserted,
      sum(rows_updated)::BIGINT AS rows_updated"""


_R10_SQL = f"""
SELECT task_type, t.task, is_runnable AS runable, max_file_load_concurrency AS concurncy,
       max(ifnull(diy_parameter::BIGINT, strftime(end_date, '%Y%m%d')::BIGINT))
         FILTER (run_status IN ('SUCCESS', 'CLOSED')) AS last_run_dt,
       strftime(max(end_date), '%H:%M:%S') AS last_run_tm,
       {_rollup_sql_measures()}
FROM (SELECT * FROM fx_tasks WHERE starts_with(task, 'Customer#') AND NOT contains(task, 'PATTERN')) AS t
LEFT JOIN (SELECT * EXCLUDE (task) FROM fx_runs) AS r USING (task_id)
GROUP BY task_type, t.task, is_runnable, parameter_type, task_business_area, task_technical_area, max_file_load_concurrency
"""


@query("task_status_rollup", "R10", _R10_SQL)
def q_task_status_rollup(spark, sf):
    fx = fixtures(spark, sf)
    return task_status_rollup(fx.tasks, fx.runs, "Customer#%", "%PATTERN%")


def _hour_rollup(tasks: DataFrame, runs: DataFrame, from_key: str, task_cond, by_task: bool) -> DataFrame:
    when = F.coalesce(F.col("end_date"), F.col("start_date"))
    hour = "last_run_tm" if by_task else "hrs"     # the two reports name the hour differently
    # The bound is on the columns themselves, so it reaches the scan.
    first = ts_lit(dt.datetime.strptime(from_key, "%Y%m%d"))
    recent = (F.col("end_date") >= first) | (F.col("end_date").isNull() & (F.col("start_date") >= first))
    r = runs.filter(recent).select("*", F.date_format(when, "yyyyMMdd").alias("date_key"),
                                   F.date_format(when, "HH").alias(hour))
    inner = ["task_id", "date_key", hour] + (["task"] if by_task else [])
    parts = _status_partials(r, inner)
    t = tasks.filter(task_cond).select("task_id", "task_type")
    outer = ["task_type", "date_key", hour] + (["task"] if by_task else [])
    merged = _merge_partials(parts.join(t, "task_id"), outer)
    return merged.select(*outer, *_status_measures(merged, HOURLY_TEXT))


def status_rollup_by_task_hour(tasks: DataFrame, runs: DataFrame, from_key: str,
                               like: str = P.S2C_TASKS, not_like: str = P.PATTERN_TASKS) -> DataFrame:
    """R10 measures per task type, day, task and hour of the run's end (or start)."""
    cond = F.col("task").like(like) & ~F.col("task").like(not_like)
    return _hour_rollup(tasks, runs, from_key, cond, True)


def status_rollup_by_hour(tasks: DataFrame, runs: DataFrame, from_key: str,
                          likes=(P.S2C_TASKS,), task_type: str = "FILE", not_like: str = P.PATTERN_TASKS) -> DataFrame:
    """R10 measures per task type, day and hour, for pattern tasks or one task type."""
    cond = reduce(lambda a, b: a | b, [F.col("task").like(p) for p in likes]) | (F.col("task_type") == task_type)
    return _hour_rollup(tasks, runs, from_key, cond & ~F.col("task").like(not_like), False)


def _hour_sql(by_task: bool, cond: str) -> str:
    hour = "last_run_tm" if by_task else "hrs"
    task = "r.task, " if by_task else ""
    return f"""
WITH r AS (
  SELECT *, ifnull(end_date, start_date) AS moment FROM fx_runs WHERE ifnull(end_date, start_date) >= TIMESTAMP '2024-01-15'
)
SELECT task_type, strftime(moment, '%Y%m%d') AS date_key, {task}strftime(moment, '%H') AS {hour},
       {_rollup_sql_measures(text_cols=HOURLY_TEXT)}
FROM r INNER JOIN (SELECT task_id, task_type FROM fx_tasks WHERE {cond}) AS t USING (task_id)
GROUP BY task_type, date_key, {task}{hour}
"""


@query("status_rollup_by_task_hour", "R11",
       _hour_sql(True, "starts_with(task, 'Customer#') AND NOT contains(task, 'PATTERN')"))
def q_status_rollup_by_task_hour(spark, sf):
    fx = fixtures(spark, sf)
    return status_rollup_by_task_hour(fx.tasks, fx.runs, "20240115", "Customer#%", "%PATTERN%")


@query("status_rollup_by_hour", "R12",
       _hour_sql(False, "NOT contains(task, 'PATTERN') AND (task_type = 'FILE' OR contains(task, 'S2C'))"))
def q_status_rollup_by_hour(spark, sf):
    fx = fixtures(spark, sf)
    return status_rollup_by_hour(fx.tasks, fx.runs, "20240115", ("%S2C%",), "FILE", "%PATTERN%")


def rollup_view_filter(rollup: DataFrame, like: str) -> DataFrame:
    """Rows of a saved rollup for matching tasks that have run, by queue."""
    r = rollup.filter(F.col("task").like(like) & F.col("last_run_dt").isNotNull())
    return r.orderBy(F.col("queue").desc(), "task", F.col("last_run_dt").desc(), F.col("fail").desc())


@query("rollup_view_filter", "R13",
       f"SELECT * FROM ({_R10_SQL}) WHERE task LIKE 'Customer#%' AND last_run_dt IS NOT NULL")
def q_rollup_view_filter(spark, sf):
    fx = fixtures(spark, sf)
    return rollup_view_filter(task_status_rollup(fx.tasks, fx.runs, "Customer#%", "%PATTERN%"), "Customer#%")


# --------------------------------------------------------------------- R14-R20
def _task_filter(runs: DataFrame, tasks_in) -> DataFrame:
    if isinstance(tasks_in, DataFrame):
        return runs.join(tasks_in.select("task").distinct(), "task", "left_semi")
    return runs.filter(F.col("task").isin(*tasks_in))


def run_listing(runs: DataFrame, tasks_in) -> DataFrame:
    """Runs of a task list (names, or a DataFrame with a ``task`` column), newest first."""
    return _task_filter(runs, tasks_in).orderBy(F.col("start_date").desc_nulls_first(), F.col("run_id").desc())


_FILE_TASKS = "(SELECT task FROM fx_tasks WHERE task_type = 'FILE')"


@query("run_listing", "R14", f"SELECT * FROM fx_runs WHERE task IN {_FILE_TASKS}")
def q_run_listing(spark, sf):
    fx = fixtures(spark, sf)
    return run_listing(fx.runs, fx.tasks.filter("task_type = 'FILE'"))


def run_times(runs: DataFrame, tasks_in, as_of_hours: float = 0.1) -> DataFrame:
    """R14 plus run time in minutes and the follow-up log query text."""
    r = _task_filter(runs, tasks_in)
    follow = F.concat_ws(
        "", F.lit("select * from dw_rt_log_app where dw_task_id="), F.col("task_id").cast("string"),
        F.lit(" and dw_batch_id="), F.col("batch_id").cast("string"), F.lit("  and dw_run_id="),
        F.col("run_id").cast("string"),
        F.lit(f" AND error_sysdate >= sysdate-{as_of_hours} and dw_inst_id="),
        F.replace(F.substring(F.trim(F.col("remark")), -2, 2), F.lit(";"), F.lit("")),
        F.lit(" order by 1 desc"))
    return r.select("run_id", "task", "run_status",
                    round_duration("start_date", "end_date", 60, 2).alias("run_time"),
                    "start_date", "end_date", "rows_loaded", "batch_id", "diy_parameter", "direct_exec_sql",
                    follow.alias("get_run_detail_logs")) \
        .orderBy(F.col("start_date").desc_nulls_last(), F.col("run_id").desc())


@query("run_times", "R15", f"""
SELECT run_id, task, run_status, {D.round_duration('start_date', 'end_date', 60, 2)} AS run_time, start_date, end_date,
       rows_loaded, batch_id, diy_parameter, direct_exec_sql,
       concat_ws('', 'select * from dw_rt_log_app where dw_task_id=', CAST(task_id AS VARCHAR), ' and dw_batch_id=',
                 CAST(batch_id AS VARCHAR), '  and dw_run_id=', CAST(run_id AS VARCHAR),
                 ' AND error_sysdate >= sysdate-0.1 and dw_inst_id=', replace(substr(trim(remark), -2, 2), ';', ''),
                 ' order by 1 desc') AS get_run_detail_logs
FROM fx_runs WHERE task IN {_FILE_TASKS}
""")
def q_run_times(spark, sf):
    fx = fixtures(spark, sf)
    return run_times(fx.runs, fx.tasks.filter("task_type = 'FILE'"))


FINISHED = ("CLOSED", "SUCCESS", "CANCELLED")


def open_runs(runs: DataFrame, like: str) -> DataFrame:
    """Runs of matching tasks not in a finished status."""
    return runs.filter(F.col("task").like(like) & ~F.col("run_status").isin(*FINISHED)) \
        .orderBy(F.col("start_date").desc_nulls_first(), F.col("run_id").desc())


@query("open_runs", "R16", """
SELECT * FROM fx_runs WHERE task LIKE 'Customer#%' AND run_status NOT IN ('CLOSED', 'SUCCESS', 'CANCELLED')
""")
def q_open_runs(spark, sf):
    return open_runs(fixtures(spark, sf).runs, "Customer#%")


def runs_with_batch_key(runs: DataFrame, batches: DataFrame, like: str) -> DataFrame:
    """Runs of matching tasks with their batch's newest date key."""
    r = runs.filter(F.col("task").like(like)).select("task", "run_status", "batch_id", "start_date", "end_date")
    j = r.join(batches.select("batch_id", "dw_max_date_key"), "batch_id")
    return j.select("task", "run_status", "batch_id", "dw_max_date_key", "start_date", "end_date") \
        .orderBy(F.col("start_date").desc_nulls_first(), F.col("batch_id").desc())


@query("runs_with_batch_key", "R17", """
SELECT a.task, a.run_status, a.batch_id, b.dw_max_date_key, a.start_date, a.end_date
FROM fx_runs a, fx_batches b WHERE a.batch_id = b.batch_id AND a.task LIKE 'Customer#%'
""")
def q_runs_with_batch_key(spark, sf):
    fx = fixtures(spark, sf)
    return runs_with_batch_key(fx.runs, fx.batches, "Customer#%")


def runs_of_area(runs: DataFrame, tasks: DataFrame, area_like: str) -> DataFrame:
    """Runs of the runnable tasks of a business area (semi join)."""
    t = tasks.filter(F.col("task_business_area").like(area_like) & (F.col("is_runnable") == "Yes")).select("task")
    return runs.join(t, "task", "left_semi").orderBy(F.col("start_date").desc_nulls_first(), F.col("run_id").desc())


@query("runs_of_area", "R18", """
SELECT * FROM fx_runs WHERE task IN (SELECT task FROM fx_tasks WHERE task_business_area LIKE '%MACH%' AND is_runnable = 'Yes')
""")
def q_runs_of_area(spark, sf):
    fx = fixtures(spark, sf)
    return runs_of_area(fx.runs, fx.tasks, "%MACH%").select(fx.runs.columns)


def status_counts(runs: DataFrame, tasks_in) -> DataFrame:
    """Number of runs per task and status for a task list."""
    return _task_filter(runs, tasks_in).groupBy("task", "run_status").agg(F.count(F.lit(1)).alias("cnt")) \
        .select("cnt", "task", "run_status")


@query("status_counts", "R19", f"""
SELECT count(*) AS cnt, task, run_status FROM fx_runs WHERE task IN {_FILE_TASKS} GROUP BY task, run_status
""")
def q_status_counts(spark, sf):
    fx = fixtures(spark, sf)
    return status_counts(fx.runs, fx.tasks.filter("task_type = 'FILE'"))


def distinct_tasks(runs: DataFrame, like: str) -> DataFrame:
    """Distinct task names, quoted, ready to paste into an IN list."""
    return runs.filter(F.col("task").like(like)).select(
        F.concat(F.lit("'"), F.col("task"), F.lit("'")).alias("quoted_task")).distinct()


@query("distinct_tasks", "R20", "SELECT DISTINCT '''' || task || '''' AS quoted_task FROM fx_runs WHERE task LIKE 'Customer#%'")
def q_distinct_tasks(spark, sf):
    return distinct_tasks(fixtures(spark, sf).runs, "Customer#%")


# --------------------------------------------------------------------- R21-R26 (snapshots)
def job_state_report(jobs: DataFrame, running: DataFrame, tasks: DataFrame, as_of: dt.datetime,
                     owners=("DW_CTL", "DW_META")) -> DataFrame:
    """Disabled jobs, and running jobs with their session and elapsed time."""
    j = jobs.filter(F.col("owner").isin(*owners)).select(
        "owner", "job_name", "state",
        F.when(F.col("state") == "RUNNING", secs_between("last_start_date", ts_lit(as_of))).alias("run_time_sec"),
        F.split_part("job_name", F.lit("#"), F.lit(2)).alias("task_id"))
    t = tasks.select(F.col("task_id").cast("string").alias("task_id"), "task")
    # Disabled and running jobs in one pass; only running jobs take a session.
    rj = running.select("job_name", F.col("session_id").alias("sid"), F.lit("RUNNING").alias("state"))
    out = j.filter(F.col("state").isin("DISABLED", "RUNNING")).join(t, "task_id", "left") \
        .join(rj, ["job_name", "state"], "left")
    cols = ["sid", "run_time_sec", "owner", "job_name", "task", "task_id", "state"]
    return out.select(cols) \
        .orderBy(F.col("task_id").desc_nulls_first(), F.col("sid").desc_nulls_first())


@query("job_state_report", "R21", f"""
SELECT session_id AS sid,
       if(jb.state = 'RUNNING', {D.secs('jb.last_start_date', D.FILES_CLOCK)}, NULL) AS run_time_sec,
       jb.owner, jb.job_name, fx_tasks.task, string_split(jb.job_name, '#')[2] AS task_id, jb.state
FROM fx_jobs AS jb
LEFT JOIN fx_running_jobs AS now_running ON jb.state = 'RUNNING' AND now_running.job_name = jb.job_name
LEFT JOIN fx_tasks ON fx_tasks.task_id = TRY_CAST(string_split(jb.job_name, '#')[2] AS BIGINT)
WHERE jb.owner = 'DW' AND jb.state IN ('RUNNING', 'DISABLED')
""")
def q_job_state_report(spark, sf):
    fx = fixtures(spark, sf)
    return job_state_report(fx.jobs, fx.running_jobs, fx.tasks, AS_OF_FILES, owners=("DW",))


def scheduled_not_running(scheduled: DataFrame, jobs: DataFrame, owner: str = "DW_META") -> DataFrame:
    """Jobs scheduled in the framework table but absent from the scheduler (MINUS)."""
    a = scheduled.filter(F.col("job_status") == "SCHEDULED").select("job_name")
    b = jobs.filter((F.col("owner") == owner) & F.col("state").isin("SCHEDULED", "RUNNING")).select("job_name")
    return a.subtract(b)


@query("scheduled_not_running", "R22", """
SELECT job_name FROM fx_scheduled_jobs WHERE job_status = 'SCHEDULED'
EXCEPT
SELECT job_name FROM fx_jobs WHERE owner = 'OPS' AND state IN ('SCHEDULED', 'RUNNING')
""")
def q_scheduled_not_running(spark, sf):
    fx = fixtures(spark, sf)
    return scheduled_not_running(fx.scheduled_jobs, fx.jobs, owner="OPS")


def job_failures_on_day(job_log: DataFrame, details: DataFrame, as_of: dt.datetime,
                        owner: str = "DW_META") -> DataFrame:
    """Non-successful scheduler runs of the ``as_of`` day, first 100 characters of the error."""
    lg = job_log.filter((F.to_date("log_date") == day_of(as_of)) & (F.col("status") != "SUCCEEDED")
                        & (F.col("owner") == owner))
    j = lg.join(details.select("log_id", "additional_info"), "log_id")
    return j.select("log_date", "owner", "job_name", "status",
                    F.substring("additional_info", 1, 100).alias("error_msg")) \
        .orderBy(F.col("log_date").desc(), "job_name")


@query("job_failures_on_day", "R23", """
SELECT a.log_date, a.owner, a.job_name, a.status, substr(b.additional_info, 1, 100) AS error_msg
FROM fx_job_log a JOIN fx_job_details b ON a.log_id = b.log_id
WHERE CAST(a.log_date AS DATE) = DATE '1998-06-15' AND a.status <> 'SUCCEEDED' AND a.owner = 'DW'
""")
def q_job_failures_on_day(spark, sf):
    fx = fixtures(spark, sf)
    return job_failures_on_day(fx.job_log, fx.job_details, dt.datetime(1998, 6, 15, 9, 0), owner="DW")


def maintenance_jobs(jobs: DataFrame, like: str) -> DataFrame:
    """Maintenance jobs with the number cut from the last three characters of the name."""
    j = jobs.filter(F.col("job_name").like(like))
    return j.select(F.replace(F.substring("job_name", -3, 3), F.lit("_"), F.lit("")).alias("jobnr"), *jobs.columns) \
        .orderBy("job_name")


@query("maintenance_jobs", "R24", """
SELECT replace(substr(job_name, -3, 3), '_', '') AS jobnr, * FROM fx_jobs WHERE job_name LIKE 'JOB#%'
""")
def q_maintenance_jobs(spark, sf):
    return maintenance_jobs(fixtures(spark, sf).jobs, "JOB#%")


def session_run_id(client_info) -> Column:
    """Run id in a session's client info: after the 10-character tag, up to the next space.

    Without such a space there is no id (NULL), as in the script.
    """
    rest = F.expr(f"substring({client_info}, 11)")
    return F.when(F.instr(rest, " ") > 0, F.substring_index(rest, " ", 1))


def orphan_runs(runs: DataFrame, sessions: DataFrame, as_of: dt.datetime, min_hours: float = 2.0) -> DataFrame:
    """RUNNING for at least ``min_hours`` with no session carrying the run id."""
    r = runs.filter((F.col("run_status") == "RUNNING")
                    & (F.col("start_date") <= ts_lit(as_of - dt.timedelta(hours=min_hours))))
    live = sessions.select(session_run_id("client_info").alias("_rid")).filter(F.col("_rid") != "")
    return r.join(live, r["run_id"].cast("string") == live["_rid"], "left_anti")


@query("orphan_runs", "R25", f"""
WITH named AS (SELECT DISTINCT {D.run_id('client_info')} AS named_run FROM fx_sessions)
SELECT fx_runs.* FROM fx_runs ANTI JOIN named ON named.named_run = fx_runs.run_id::VARCHAR
WHERE run_status = 'RUNNING' AND start_date <= {D.RUNS_CLOCK} - INTERVAL 2 HOUR
""")
def q_orphan_runs(spark, sf):
    fx = fixtures(spark, sf)
    return orphan_runs(fx.runs, fx.sessions, AS_OF_RUNS, 2.0)


def run_sessions(runs: DataFrame, sessions: DataFrame, as_of: dt.datetime, status: str = "RUNNING") -> DataFrame:
    """Runs with the session carrying their id (parsed from client info) and minutes so far."""
    r = runs.filter(F.col("run_status") == status)
    g = sessions.select(session_run_id("client_info").alias("_rid"), "sid")
    j = r.join(g, r["run_id"].cast("string") == g["_rid"], "left")
    return j.select("sid", "run_id", "task", "run_status",
                    F.round(secs_between("start_date", ts_lit(as_of)) / 60, 0).cast("long").alias("run_time_mins"))


@query("run_sessions", "R26", f"""
SELECT s.sid, r.run_id, r.task, r.run_status, round({D.secs('r.start_date', D.RUNS_CLOCK)} / 60)::BIGINT AS run_time_mins
FROM (SELECT * FROM fx_runs WHERE run_status = 'RUNNING') AS r
LEFT JOIN fx_sessions AS s ON {D.run_id('s.client_info')} = r.run_id::VARCHAR
""")
def q_run_sessions(spark, sf):
    fx = fixtures(spark, sf)
    return run_sessions(fx.runs, fx.sessions, AS_OF_RUNS)


# --------------------------------------------------------------------- intervals
def run_intervals(runs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Run times as day-time intervals: elapsed, time since the start, and the elapsed seconds of a thousand rows.

    ``elapsed`` and ``age`` are differences of clocks, ``per_thousand`` is made
    from a number; all three are interval columns, which add and compare as such.
    """
    secs = F.try_divide(micros_between("start_date", "end_date").cast("decimal(38,0)") / F.lit(1000), F.nullif(F.col("rows_loaded"), F.lit(0)))
    return runs.select("run_id", "task", interval_between("start_date", "end_date").alias("elapsed"),
                       interval_between("start_date", ts_lit(as_of)).alias("age"), numtodsinterval(F.round(secs, 6)).alias("per_thousand"))


_PER_THOUSAND = "CAST(round(date_diff('microsecond', start_date, end_date) * 1000 / nullif(rows_loaded, 0)) AS BIGINT)"


@query("run_intervals", "2.18", f"""
SELECT run_id, task, {D.interval_text("date_diff('microsecond', start_date, end_date)")} AS elapsed,
       {D.interval_text(f"date_diff('microsecond', start_date, {D.RUNS_CLOCK})")} AS age,
       {D.interval_text(_PER_THOUSAND)} AS per_thousand,
       date_diff('microsecond', start_date, end_date) > 20000000 AS long
FROM fx_runs
""")
def q_run_intervals(spark, sf):
    r = run_intervals(fixtures(spark, sf).runs, AS_OF_RUNS)
    return r.select("run_id", "task", *[interval_text(F.col(c)).alias(c) for c in ("elapsed", "age", "per_thousand")],
                    (F.col("elapsed") > numtodsinterval(F.lit(20))).alias("long"))
