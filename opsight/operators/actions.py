"""State changes and derived text as pure table functions.

Every function returns the *new contents* of the table it would change
(``delta=True``: only the changed rows); writing them back atomically - an
overwrite of a snapshot or a table-format MERGE - is the caller's.  Nothing
here executes the rendered texts.  Set-based forms replace the scripts'
cursor loops; where two loop iterations could touch the same row, the
highest run id wins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.functions import duck as D
from opsight.functions import texts as T
from opsight.functions.expr import days_ago, key_to_date, ts_lit
from opsight.operators.sessions import failing_tasks_by_message
from opsight.functions import patterns as P
from opsight.plans.joins import without
from opsight.plans.numbering import global_row_number
from opsight.plans.registry import query
from opsight.sources.fixtures import AS_OF_FILES, AS_OF_RUNS, fixtures


def _apply(df: DataFrame, pred: Column, sets: dict, delta: bool) -> DataFrame:
    """``UPDATE df SET col = value WHERE pred`` as a projection (row count and order kept)."""
    hit = F.coalesce(pred, F.lit(False))
    def new(c):
        v = sets[c]
        val = v if isinstance(v, Column) else F.lit(v)
        return F.when(hit, val).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c)

    cols = [new(c) if c in sets else F.col(c) for c in df.columns]
    out = df.select(*cols, hit.alias("__hit"))
    return (out.filter("__hit") if delta else out).drop("__hit")


# --------------------------------------------------------------------- D1, D3, D4
def set_status(runs: DataFrame, predicate: Column, status: str, delta: bool = False, extra: dict | None = None) -> DataFrame:
    """Conditional status update (``UPDATE runs SET run_status = ... WHERE predicate``)."""
    return _apply(runs, predicate, {"run_status": status, **(extra or {})}, delta)


@query("set_status", "D1", """
SELECT run_id, task_id, batch_id, task,
       CASE WHEN coalesce(run_status = 'FAILED' AND rows_error > 50, false) THEN 'RUNABLE' ELSE run_status END AS run_status,
       start_date, end_date, rows_loaded, rows_error, rows_inserted, rows_updated, diy_parameter, direct_exec_sql, remark
FROM fx_runs
""")
def q_set_status(spark, sf):
    r = fixtures(spark, sf).runs
    return set_status(r, (F.col("run_status") == "FAILED") & (F.col("rows_error") > 50), "RUNABLE")


def set_attribute(df: DataFrame, predicate: Column, column: str, value, delta: bool = False) -> DataFrame:
    """Conditional update of one column of a configuration table."""
    return _apply(df, predicate, {column: value}, delta)


@query("set_attribute", "D3", """
SELECT task_id, task, CASE WHEN task_business_area = 'BUILDING' THEN 20240130 ELSE max_key END AS max_key, is_runnable, task_type,
       parameter_type, task_business_area, task_technical_area, task_target_type, source_system, pattern_task,
       copy_batch_ind, super_batch_ind, max_file_load_concurrency, flex1, flex2
FROM fx_tasks
""")
def q_set_attribute(spark, sf):
    t = fixtures(spark, sf).tasks
    return set_attribute(t, F.col("task_business_area") == "BUILDING", "max_key", 20240130)


def fill_nulls(df: DataFrame, column: str, value, batch_ids=None, delta: bool = False) -> DataFrame:
    """Default value for a NULL column, optionally only in some batches."""
    pred = F.col(column).isNull()
    if batch_ids is not None:
        pred = pred & F.col("batch_id").isin(*batch_ids)
    return _apply(df, pred, {column: value}, delta)


@query("fill_nulls", "D4", "SELECT batch_id, record_type, coalesce(code, 'X') AS code, item_key FROM fx_staging")
def q_fill_nulls(spark, sf):
    return fill_nulls(fixtures(spark, sf).staging, "code", "X")


# --------------------------------------------------------------------- D2
def hold_all_but_top(runs: DataFrame, task_like: str, day: str | None = None, statuses=("FAILED",),
                     hold_status: str = "HOLD_MK", delta: bool = False) -> DataFrame:
    """Hold the runs of each task whose batch is not the one with most rows (ties kept).

    Top = rank 1 of ``rows_loaded`` descending with NULLs first (the scripts'
    database ordering), per task and run day.  ``NOT IN`` semantics: if a top
    batch id is NULL, nothing of that task/day is held.  The top is found by
    aggregation (max / null count per group), not by a window over the group.
    """
    cand = runs.filter(F.col("task").like(task_like))
    if day is not None:
        cand = cand.filter(F.col("diy_parameter") == day)
    keys = ["task", "diy_parameter"]
    stats = cand.groupBy(*keys).agg(F.max("rows_loaded").alias("_mx"),
                                    F.count(F.when(F.col("rows_loaded").isNull(), 1)).alias("_nulls"))
    top = cand.join(stats, keys).filter(
        F.when(F.col("_nulls") > 0, F.col("rows_loaded").isNull()).otherwise(F.col("rows_loaded") == F.col("_mx")))
    # Membership by join on the distinct top keys (no per-group collection).
    tops = top.select(*keys, "batch_id").filter(F.col("batch_id").isNotNull()).distinct() \
        .withColumn("_in_top", F.lit(True))
    null_top = top.groupBy(*keys).agg(F.count(F.when(F.col("batch_id").isNull(), 1)).alias("_null_top"))
    j = runs.join(tops, [*keys, "batch_id"], "left").join(null_top, keys, "left")
    pred = (F.col("task").like(task_like) & F.col("run_status").isin(*statuses) & F.col("_null_top").isNotNull()
            & (F.col("_null_top") == 0) & F.col("_in_top").isNull() & F.col("batch_id").isNotNull())
    if day is not None:
        pred = pred & (F.col("diy_parameter") == day)
    return _apply(j.select(*runs.columns, "_in_top", "_null_top"), pred, {"run_status": hold_status}, delta) \
        .drop("_in_top", "_null_top")


@query("hold_all_but_top", "D2", """
WITH ranked AS (
  SELECT task, diy_parameter, batch_id,
         rank() OVER (PARTITION BY task, diy_parameter ORDER BY rows_loaded DESC NULLS FIRST) AS rnk
  FROM fx_runs WHERE task LIKE 'Customer#%'),
tops AS (SELECT task, diy_parameter, batch_id FROM ranked WHERE rnk = 1)
SELECT run_id, task_id, batch_id, task,
       CASE WHEN task LIKE 'Customer#%' AND run_status IN ('FAILED')
                 AND batch_id NOT IN (SELECT t.batch_id FROM tops t WHERE t.task = r.task AND t.diy_parameter = r.diy_parameter)
            THEN 'HOLD_MK' ELSE run_status END AS run_status,
       start_date, end_date, rows_loaded, rows_error, rows_inserted, rows_updated, diy_parameter, direct_exec_sql, remark
FROM fx_runs r
""")
def q_hold_all_but_top(spark, sf):
    return hold_all_but_top(fixtures(spark, sf).runs, "Customer#%")


# --------------------------------------------------------------------- D5-D6
def advance_watermark(tasks: DataFrame, runs: DataFrame, as_of: dt.datetime, watermark_task: str,
                      gate_tasks) -> tuple[DataFrame, DataFrame]:
    """Advance a process date by one day when the gate tasks loaded rows for it.

    Returns (new tasks, log row).  The decision is a one-row aggregate crossed
    with the task table (a bounded broadcast).
    """
    key = tasks.filter(F.col("task") == watermark_task).select(F.max("max_key").alias("pd"))
    gate = runs.filter(F.col("task").isin(*gate_tasks)).select("diy_parameter", "rows_loaded")
    y = (as_of - dt.timedelta(days=1)).strftime("%Y%m%d")
    dec = key.join(gate, gate["diy_parameter"] == key["pd"].cast("string"), "left").groupBy("pd").agg(
        F.sum("rows_loaded").alias("n_cnt"))
    pd_txt = F.col("pd").cast("string")
    nxt = F.date_format(F.date_add(key_to_date("pd"), 1), "yyyyMMdd").cast("int")
    advance = (F.col("n_cnt") >= 1) & (pd_txt < y)
    dec = dec.select(
        F.lit(watermark_task).alias("task"), F.col("pd").alias("old_key"),
        F.when(advance, nxt).otherwise(F.col("pd")).alias("new_key"),
        F.lit(T.ADVANCEMENT_PROCESS).alias("process_name"),
        F.when(advance, F.concat(F.lit(watermark_task + T.ADVANCED_TO), nxt.cast("string"), F.lit(".")))
         .when(pd_txt == y, F.lit(T.IS_DAY_MINUS_1))
         .otherwise(F.lit(T.NOT_ADVANCED.format(gate=gate_tasks[0]))).alias("message"),
        F.lit("I").alias("level"))
    new_tasks = tasks.join(F.broadcast(dec.select("task", "new_key")), "task", "left").select(
        *[F.coalesce("new_key", "max_key").alias("max_key") if c == "max_key" else F.col(c) for c in tasks.columns])
    return new_tasks, dec


@query("advance_watermark", "D5", """
SELECT 'Customer#000000010' AS task, pd AS old_key,
       CASE WHEN n_cnt >= 1 AND CAST(pd AS VARCHAR) < '20240130'
            THEN CAST(strftime(CAST(strptime(CAST(pd AS VARCHAR), '%Y%m%d') AS DATE) + 1, '%Y%m%d') AS INTEGER) ELSE pd END AS new_key,
       'IT Auto-Advancement' AS process_name,
       CASE WHEN n_cnt >= 1 AND CAST(pd AS VARCHAR) < '20240130'
              THEN 'Customer#000000010 process date advanced to '
                   || strftime(CAST(strptime(CAST(pd AS VARCHAR), '%Y%m%d') AS DATE) + 1, '%Y%m%d') || '.'
            WHEN CAST(pd AS VARCHAR) = '20240130' THEN 'Process Date is DAY-1.'
            ELSE 'Date NOT advanced due to previous days summaries Customer#000000011 not loading any rows.' END AS message,
       'I' AS level
FROM (SELECT k.pd, sum(g.rows_loaded) AS n_cnt
      FROM (SELECT max(max_key) AS pd FROM fx_tasks WHERE task = 'Customer#000000010') k
      LEFT JOIN (SELECT diy_parameter, rows_loaded FROM fx_runs WHERE task IN ('Customer#000000011', 'Customer#000000012')) g
        ON g.diy_parameter = CAST(k.pd AS VARCHAR)
      GROUP BY k.pd)
""")
def q_advance_watermark(spark, sf):
    fx = fixtures(spark, sf)
    return advance_watermark(fx.tasks, fx.runs, AS_OF_RUNS, "Customer#000000010",
                             ("Customer#000000011", "Customer#000000012"))[1]


def set_watermark_to_yesterday(tasks: DataFrame, task_like: str, as_of: dt.datetime, delta: bool = False) -> DataFrame:
    """Daily reset: the matching tasks' high-water key becomes yesterday's key."""
    y = int((as_of - dt.timedelta(days=1)).strftime("%Y%m%d"))
    return _apply(tasks, F.col("task").like(task_like), {"max_key": y}, delta)


@query("set_watermark_to_yesterday", "D6", """
SELECT task_id, task, 20240130 AS max_key FROM fx_tasks WHERE task = 'Customer#000000012'
""")
def q_set_watermark_to_yesterday(spark, sf):
    return set_watermark_to_yesterday(fixtures(spark, sf).tasks, "Customer#000000012", AS_OF_RUNS, delta=True) \
        .select("task_id", "task", "max_key")


# --------------------------------------------------------------------- D7
def merge_update(target: DataFrame, source: DataFrame, on, set_cols) -> DataFrame:
    """``MERGE ... WHEN MATCHED THEN UPDATE SET``: matched rows take the source values (NULLs too)."""
    on = [on] if isinstance(on, str) else list(on)
    src = source.select(*on, *[F.col(c).alias(f"__s_{c}") for c in set_cols]).withColumn("__m", F.lit(True))
    j = target.join(src, on, "left")
    cols = [F.when(F.col("__m"), F.col(f"__s_{c}")).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
            for c in target.columns]
    return j.select(*cols)


@query("merge_update", "D7", """
WITH registered AS (
  SELECT short_filename AS name, min(processing_status) AS lowest, max(processing_status) AS highest, count(*) AS times
  FROM fx_files GROUP BY ALL
)
SELECT name, lowest AS min_processing_status, highest AS max_processing_status, times AS file_count
FROM fx_manifest LEFT JOIN registered USING (name)
""")
def q_merge_update(spark, sf):
    fx = fixtures(spark, sf)
    target = fx.manifest.select("name", F.lit(None).cast("string").alias("min_processing_status"),
                                F.lit(None).cast("string").alias("max_processing_status"),
                                F.lit(None).cast("long").alias("file_count"))
    src = fx.files.groupBy(F.col("short_filename").alias("name")).agg(
        F.min("processing_status").alias("min_processing_status"),
        F.max("processing_status").alias("max_processing_status"), F.count(F.lit(1)).alias("file_count"))
    return merge_update(target, src, "name", ["min_processing_status", "max_processing_status", "file_count"])


# --------------------------------------------------------------------- D8-D9
def spread_start_times(runs: DataFrame, task_like: str, lo: int, hi: int, per_day: int = 2000,
                       base: dt.datetime = dt.datetime(2014, 4, 1)) -> DataFrame:
    """Number runnable runs per task and day (newest batch first), keep ``per_day``,
    and set each start to ``base + n`` seconds.

    The ``rn <= per_day`` filter becomes a WindowGroupLimit: each map task keeps
    at most ``per_day`` rows per (task, day) before the shuffle, so a hot day
    never ships more than that.
    """
    key = F.col("diy_parameter").try_cast("int")
    c = runs.filter((F.col("run_status") == "RUNABLE") & F.col("task").like(task_like)
                    & key.between(lo, hi))
    w = Window.partitionBy("task", "diy_parameter").orderBy(F.col("batch_id").desc(), F.col("run_id").desc())
    picked = c.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= per_day) \
        .select("run_id", F.timestamp_add("SECOND", F.col("__rn"), ts_lit(base)).alias("start_date"))
    return merge_update(runs, picked, "run_id", ["start_date"])


@query("spread_start_times", "D8", """
SELECT run_id, task_id, batch_id, task, run_status,
       CASE WHEN place <= 2000 THEN TIMESTAMP '2014-04-01 00:00:00' + to_seconds(place) ELSE start_date END AS start_date,
       end_date, rows_loaded, rows_error, rows_inserted, rows_updated, diy_parameter, direct_exec_sql, remark
FROM (
  SELECT *, CASE WHEN movable THEN rank() OVER (PARTITION BY movable, task, diy_parameter ORDER BY batch_id DESC, run_id DESC) END AS place
  FROM (SELECT *, run_status = 'RUNABLE' AND starts_with(task, 'Customer#')
                  AND ifnull(TRY_CAST(diy_parameter AS INTEGER) BETWEEN 20240110 AND 20240120, FALSE) AS movable FROM fx_runs)
)
""")
def q_spread_start_times(spark, sf):
    return spread_start_times(fixtures(spark, sf).runs, "Customer#%", 20240110, 20240120, per_day=2000)


def start_from_parameter(runs: DataFrame, task_like: str, max_key: int, delta: bool = False) -> DataFrame:
    """Runnable runs up to ``max_key`` start on their parameter day, rows cleared (serial load first)."""
    d = key_to_date("diy_parameter").cast("timestamp_ntz")
    pred = ((F.col("run_status") == "RUNABLE") & F.col("task").like(task_like)
            & (F.col("diy_parameter").try_cast("int") <= max_key) & (F.col("start_date") != d))
    return _apply(runs, pred, {"start_date": d, "rows_loaded": F.lit(None)}, delta)


@query("start_from_parameter", "D9", """
WITH judged AS (
  SELECT *, TRY_STRPTIME(diy_parameter, '%Y%m%d') AS day,
         ifnull(run_status = 'RUNABLE' AND starts_with(task, 'Customer#') AND TRY_CAST(diy_parameter AS INTEGER) <= 20240115
                AND start_date <> TRY_STRPTIME(diy_parameter, '%Y%m%d'), FALSE) AS moved
  FROM fx_runs
)
SELECT * EXCLUDE (day, moved) REPLACE (if(moved, day, start_date) AS start_date, if(moved, NULL, rows_loaded) AS rows_loaded)
FROM judged
""")
def q_start_from_parameter(spark, sf):
    return start_from_parameter(fixtures(spark, sf).runs, "Customer#%", 20240115)


# --------------------------------------------------------------------- D10
def close_group_runs(tasks: DataFrame, steps: DataFrame, runs: DataFrame, batches: DataFrame, as_of: dt.datetime,
                     group_like: str = P.GROUP_TASKS, template_like: str = P.GROUP_TEMPLATE
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pass a group task's runnable runs through without running them.

    Runs: RUNABLE runs of group tasks whose batch is not BATCHED -> CLOSED,
    end = ``as_of``.  Batches of those runs with super-batch flag C or N move
    to the run's task; if two runs share a batch the highest run id wins.
    Returns (new runs, new batches, log) - the log has one row per group task
    with its number of updated runs, as the procedure writes it.
    """
    g = tasks.filter(F.col("task").like(group_like)).select("task_id") \
        .join(steps.filter(F.col("template_name").like(template_like)).select("task_id"), "task_id").distinct()
    b = batches.filter(F.col("load_status") != "BATCHED").select("batch_id")
    picked = runs.filter(F.col("run_status") == "RUNABLE").join(g, "task_id", "left_semi") \
        .join(b, "batch_id", "left_semi").select("run_id", "batch_id", "task_id")
    closed = picked.select("run_id", F.lit("CLOSED").alias("run_status"), ts_lit(as_of).alias("end_date"))
    new_runs = merge_update(runs, closed, "run_id", ["run_status", "end_date"])
    winner = picked.groupBy("batch_id").agg(F.max_by("task_id", "run_id").alias("task_id"))
    movable = batches.filter(F.col("super_batch_ind").isin("C", "N")).select("batch_id")
    new_batches = merge_update(batches, winner.join(movable, "batch_id", "left_semi"), "batch_id", ["task_id"])
    counts = picked.groupBy("task_id").agg(F.count(F.lit(1)).alias("updates"))
    log = g.join(counts, "task_id", "left").join(tasks.select("task_id", "task"), "task_id").select(
        F.lit(T.GROUP_RUN_PROCESS).alias("process_name"), "task_id", "task",
        F.coalesce("updates", F.lit(0)).alias("updates"),
        F.concat(F.lit(T.GROUP_RUN_ENDED), F.col("task"), F.lit(" "), F.coalesce("updates", F.lit(0)).cast("string"),
                 F.lit(T.GROUP_RUN_UPDATES)).alias("message"))
    return new_runs, new_batches, log


@query("close_group_runs", "D10", f"""
WITH passed AS (
  SELECT run_id FROM fx_runs
  WHERE run_status = 'RUNABLE'
    AND EXISTS (FROM fx_batches bt WHERE bt.batch_id = fx_runs.batch_id AND bt.load_status <> 'BATCHED')
    AND EXISTS (FROM fx_tasks tk INNER JOIN fx_steps st USING (task_id)
                WHERE tk.task_id = fx_runs.task_id AND starts_with(tk.task, 'Customer#') AND ends_with(st.template_name, 'STD_GROUP_TASK'))
)
SELECT * REPLACE (
  if(run_id IN (FROM passed), 'CLOSED', run_status) AS run_status,
  if(run_id IN (FROM passed), {D.RUNS_CLOCK}, end_date) AS end_date)
FROM fx_runs
""")
def q_close_group_runs(spark, sf):
    fx = fixtures(spark, sf)
    return close_group_runs(fx.tasks, fx.steps, fx.runs, fx.batches, AS_OF_RUNS, "Customer#%")[0]


# --------------------------------------------------------------------- D11-D12
def reset_by_error_log(log: DataFrame, runs: DataFrame, ranges: DataFrame, as_of: dt.datetime, task_like: str,
                       message_like: str, process: str = "DW_SCHED", days: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Tasks found by G3: their recent failed runs and failed ranges go back to RUNABLE."""
    t = failing_tasks_by_message(log, runs, as_of, task_like, message_like, process, days)
    r = runs.join(t.withColumn("__t", F.lit(True)), "task", "left").select(*runs.columns, "__t")
    pred = F.col("__t") & (F.col("run_status") == "FAILED") & (F.col("start_date") > days_ago(as_of, days))
    new_runs = _apply(r, pred, {"run_status": "RUNABLE", "start_date": days_ago(as_of, 100)}, False).drop("__t")
    g = ranges.join(t.withColumn("__t", F.lit(True)), "task", "left").select(*ranges.columns, "__t")
    new_ranges = _apply(g, F.col("__t") & (F.col("run_status") == "FAILED"), {"run_status": "RUNABLE"}, False).drop("__t")
    return new_runs, new_ranges


@query("reset_by_error_log", "D11", f"""
WITH hit AS (
  SELECT DISTINCT r.task
  FROM fx_runs r SEMI JOIN (
    SELECT task_id FROM fx_log
    WHERE process_name = 'DW_KERNEL' AND error_code = 'E' AND contains(message, 'partition number is invalid')
      AND error_sysdate > {D.RUNS_CLOCK} - INTERVAL 1 DAY) AS said ON said.task_id = r.task_id
  WHERE r.run_status = 'FAILED' AND starts_with(r.task, 'Customer#')
), judged AS (
  SELECT fx_runs.*, ifnull(run_status = 'FAILED' AND start_date > {D.RUNS_CLOCK} - INTERVAL 1 DAY AND task IN (FROM hit), FALSE) AS again
  FROM fx_runs
)
SELECT * EXCLUDE (again) REPLACE (
  if(again, 'RUNABLE', run_status) AS run_status,
  if(again, {D.RUNS_CLOCK} - INTERVAL 100 DAY, start_date) AS start_date)
FROM judged
""")
def q_reset_by_error_log(spark, sf):
    fx = fixtures(spark, sf)
    return reset_by_error_log(fx.log, fx.runs, fx.ranges, AS_OF_RUNS, "Customer#%", "%partition number is invalid%",
                              "DW_KERNEL", 1.0)[0]


def reset_failed(runs: DataFrame, like: str = "%", not_like: str | None = None, run_ids=None,
                 delta: bool = False) -> DataFrame:
    """Failed runs back to RUNABLE by name pattern (and exclusion) or run ids."""
    pred = (F.col("run_status") == "FAILED") & F.col("task").like(like)
    if not_like is not None:
        pred = pred & ~F.col("task").like(not_like)
    if run_ids is not None:
        pred = pred & F.col("run_id").isin(*run_ids)
    return _apply(runs, pred, {"run_status": "RUNABLE"}, delta)


def reset_failed_batches(batches: DataFrame, batch_ids=None, delta: bool = False) -> DataFrame:
    """Failed-audit batches back to LOADED, optionally by id."""
    pred = F.col("load_status") == "AUDITFAILED"
    if batch_ids is not None:
        pred = pred & F.col("batch_id").isin(*batch_ids)
    return _apply(batches, pred, {"load_status": "LOADED"}, delta)


@query("reset_failed", "D12", """
SELECT run_id, task_id, batch_id, task, 'RUNABLE' AS run_status, start_date, end_date, rows_loaded, rows_error,
       rows_inserted, rows_updated, diy_parameter, direct_exec_sql, remark
FROM fx_runs WHERE run_status = 'FAILED' AND task LIKE 'Customer#%' AND task NOT LIKE '%PATTERN%'
""")
def q_reset_failed(spark, sf):
    return reset_failed(fixtures(spark, sf).runs, "Customer#%", "%PATTERN%", delta=True)


# --------------------------------------------------------------------- D13-D16
def cascade_delete(tables: dict, batch_ids: DataFrame) -> dict:
    """Remove a set of batches from runs, files, batches and file-keyed tables.

    ``tables``: name -> DataFrame; tables with ``batch_id`` lose those rows,
    tables keyed by ``file_key`` or ``run_id`` (histograms, run errors) lose the
    rows of the deleted files and runs (keys are found first, as the script does).
    """
    ids = batch_ids.select("batch_id").distinct()
    n = ids.count()
    out = {}
    files, runs = tables.get("files"), tables.get("runs")
    dead_files = files.join(ids, "batch_id", "left_semi").select("file_key").distinct() if files is not None else None
    dead_runs = runs.join(ids, "batch_id", "left_semi").select("run_id").distinct() if runs is not None else None
    for name, df in tables.items():
        if "batch_id" in df.columns:
            out[name] = without(df, "batch_id", ids, n)
        elif "file_key" in df.columns and dead_files is not None:
            out[name] = without(df, "file_key", dead_files)
        elif "run_id" in df.columns and dead_runs is not None:     # run errors
            out[name] = without(df, "run_id", dead_runs)
        else:
            out[name] = df
    return out


@query("cascade_delete", "D13", """
SELECT * FROM fx_files WHERE batch_id NOT IN (SELECT batch_id FROM fx_batches WHERE load_status = 'AUDITFAILED' AND record_count = 0)
""")
def q_cascade_delete(spark, sf):
    fx = fixtures(spark, sf)
    ids = fx.batches.filter("load_status = 'AUDITFAILED' AND record_count = 0")
    return cascade_delete({"files": fx.files, "runs": fx.runs, "batches": fx.batches}, ids)["files"]


def insert_rows(target: DataFrame, rows: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    """Append rows with ids ``max(id) + n`` (sequence gaps are not reproduced)."""
    base = target.select(F.coalesce(F.max(id_col), F.lit(0)).alias("__base"))
    numbered = global_row_number(rows, order, "__n")
    new = numbered.crossJoin(F.broadcast(base)).withColumn(id_col, (F.col("__base") + F.col("__n")).cast("long"))
    return target.unionByName(new.select(*target.columns))


@query("insert_rows", "D14", """
SELECT * FROM fx_queue
UNION ALL
SELECT 'MAINT', 'REBUILD', 'Brand#' || CAST(task_id % 25 + 1 AS VARCHAR), 'P_NEW', 'P_NEW_S0', 'ready', 0.0,
       CAST((SELECT max(gboffset) FROM fx_queue) + row_number() OVER (ORDER BY task_id) AS DOUBLE),
       TIMESTAMP '2001-11-05 00:00:00', CAST(1 AS BIGINT), task_id
FROM fx_tasks WHERE task_type = 'FILE'
""")
def q_insert_rows(spark, sf):
    fx = fixtures(spark, sf)
    q = fx.queue.withColumn("gboffset", F.col("gboffset").cast("double"))
    rows = fx.tasks.filter("task_type = 'FILE'").select(
        F.lit("MAINT").alias("queue_name"), F.lit("REBUILD").alias("op"),
        F.concat(F.lit("Brand#"), (F.col("task_id") % 25 + 1).cast("string")).alias("segment_name"),
        F.lit("P_NEW").alias("partition_name"), F.lit("P_NEW_S0").alias("subpartition_name"),
        F.lit("ready").alias("status"), F.lit(0.0).alias("sizmb"), F.lit(None).cast("double").alias("gboffset"),
        ts_lit(AS_OF_FILES).alias("start_date"), F.lit(1).cast("long").alias("inst_id"),
        F.col("task_id").alias("sid"))
    return insert_rows(q, rows, "gboffset", [F.col("sid")])


def insert_if_absent(target: DataFrame, rows: DataFrame, keys) -> DataFrame:
    """Add rows whose key is not present yet (at most once per key)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    new = rows.dropDuplicates(keys).join(target.select(*keys).distinct(), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


@query("insert_if_absent", "D15", """
SELECT batch_id, task_id, table_name, dw_date_key, load_status FROM fx_batches
UNION ALL
SELECT DISTINCT -task_id AS batch_id, task_id, 'DUMMY' AS table_name, 20011105 AS dw_date_key, 'LOADED' AS load_status
FROM fx_tasks t WHERE NOT EXISTS (SELECT 1 FROM fx_batches b WHERE b.task_id = t.task_id AND b.dw_date_key = 19980315)
  AND -task_id NOT IN (SELECT batch_id FROM fx_batches)
""")
def q_insert_if_absent(spark, sf):
    fx = fixtures(spark, sf)
    tgt = fx.batches.select("batch_id", "task_id", "table_name", "dw_date_key", "load_status")
    have = fx.batches.filter("dw_date_key = 19980315").select("task_id")
    dummies = fx.tasks.join(have, "task_id", "left_anti").select(
        (-F.col("task_id")).alias("batch_id"), "task_id", F.lit("DUMMY").alias("table_name"),
        F.lit(20011105).alias("dw_date_key"), F.lit("LOADED").alias("load_status"))
    return insert_if_absent(tgt, dummies, "batch_id")


def add_columns(df: DataFrame, columns: dict) -> DataFrame:
    """``ALTER TABLE ADD (...)``: new NULL columns of the given types."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def create_as_select(df: DataFrame, table: str, mode: str = "overwrite") -> None:
    """``CREATE TABLE AS SELECT`` into the catalog (the only writing helper)."""
    df.write.mode(mode).saveAsTable(table)


@query("add_columns", "D16", """
SELECT name, CAST(NULL AS VARCHAR) AS min_processing_status, CAST(NULL AS VARCHAR) AS max_processing_status,
       CAST(NULL AS BIGINT) AS file_count FROM fx_manifest
""")
def q_add_columns(spark, sf):
    return add_columns(fixtures(spark, sf).manifest, {"min_processing_status": "string",
                                                      "max_processing_status": "string", "file_count": "bigint"})


# --------------------------------------------------------------------- D17
def render_actions(df: DataFrame, template: str, cols, alias: str = "action") -> DataFrame:
    """One text per row from a ``%s`` template; the text is returned, never executed."""
    return df.select(F.format_string(template, *[F.col(c).cast("string") for c in cols]).alias(alias))


@query("render_actions", "D17", """
SELECT 'mv -f ' || short_filename || ' ' || path || '/' AS action FROM fx_files WHERE processing_status = 'ARCHIVED'
""")
def q_render_actions(spark, sf):
    f = fixtures(spark, sf).files.filter("processing_status = 'ARCHIVED'")
    return render_actions(f, "mv -f %s %s/", ["short_filename", "path"])
