"""The framework's look-up functions and the second outputs of state changes.

A look-up is a join on the looked-up name or key, so it works for a column of
any length; the state changes of ``actions`` return several tables, and each
that its first query does not show has a query here.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsight.functions import duck as D
from opsight.functions.expr import key_of
from opsight.operators.actions import (
    advance_watermark, cascade_delete, close_group_runs, reset_by_error_log, reset_failed_batches,
)
from opsight.operators.batches import batch_lookup
from opsight.operators.files import dump_counts, file_lookup
from opsight.operators.sessions import log_tail
from opsight.operators.throughput import log_span_parse
from opsight.plans.joins import not_in
from opsight.plans.registry import query
from opsight.sources.fixtures import AS_OF_FILES, AS_OF_RUNS, fixtures


def of_tasks(df: DataFrame, tasks: DataFrame, like: str) -> DataFrame:
    """Rows of the tasks whose name matches: the id look-up by name, for any table with ``task_id``."""
    return df.join(tasks.filter(F.col("task").like(like)).select("task_id").distinct(), "task_id", "left_semi").select(df.columns)


@query("log_tail_of_task", "2.20", """
SELECT l.* FROM fx_log l SEMI JOIN (SELECT task_id FROM fx_tasks WHERE task LIKE 'Customer#00000001%') USING (task_id)
WHERE l.error_code = 'E' AND l.error_sysdate > TIMESTAMP '2024-01-31' - INTERVAL 20 DAY
""")
def q_log_tail_of_task(spark, sf):
    fx = fixtures(spark, sf)
    return log_tail(of_tasks(fx.log, fx.tasks, "Customer#00000001%"), AS_OF_RUNS, code="E", days=20)


@query("dump_counts_of_task", "2.20", """
SELECT left(short_filename, 8) AS date_key, processing_status, max_dw_date_key, count(*) AS dumps,
       sum(row_count)::BIGINT AS record_count, max(register_datetime) AS max_register_datetime
FROM fx_files SEMI JOIN (SELECT task_id FROM fx_tasks WHERE ends_with(task, '7')) USING (task_id)
GROUP BY ALL
""")
def q_dump_counts_of_task(spark, sf):
    fx = fixtures(spark, sf)
    return dump_counts(of_tasks(fx.files, fx.tasks, "%7"))


@query("log_spans_of_task", "2.20", f"""
WITH own AS (
  SELECT run_id, error_sysdate, message FROM fx_log SEMI JOIN (SELECT task_id FROM fx_tasks WHERE ends_with(task, '5')) USING (task_id)
  WHERE error_sysdate > TIMESTAMP '2024-01-31' - INTERVAL 10 DAY
), spans AS (
  SELECT run_id, max(if(message[:24] = '  Concatenating DAT File', error_sysdate, NULL)) AS concat_start,
         max(if(message[:31] = '  Concatenated DAT File Created', error_sysdate, NULL)) AS concat_end,
         max(if(message[:13] = '1-2) STEP END', message, NULL)) AS message
  FROM own GROUP BY run_id
)
SELECT run_id, concat_start, concat_end, message,
       round(regexp_extract(message, '([0-9]+) rows', 1)::DOUBLE / nullif(regexp_extract(message, 'END ([0-9]+) secs', 1)::DOUBLE, 0), 2) AS rows_loaded_per_second,
       {D.round_duration('concat_start', 'concat_end', 60, 2)} AS concat_elapsed_mins
FROM spans WHERE concat_start IS NOT NULL OR concat_end IS NOT NULL OR message IS NOT NULL
""")
def q_log_spans_of_task(spark, sf):
    fx = fixtures(spark, sf)
    return log_span_parse(of_tasks(fx.log, fx.tasks, "%5"), AS_OF_RUNS, 10)


def move_listing(names: DataFrame, n: int, folder: str) -> DataFrame:
    """The first ``n`` names of a listing, in order, each with its move command (``ls * | head -n | awk``).

    A top-k: every task keeps its first ``n`` names, so no more than that meet.
    """
    text = F.concat(F.lit("mv  "), F.col("name"), F.lit(f" {folder} ; echo DONE_"), F.col("name"))
    return names.select("name").orderBy("name").limit(n).select("name", text.alias("command"))


@query("move_listing", "2.15", """
SELECT name, 'mv  ' || name || ' /data/incoming ; echo DONE_' || name AS command FROM fx_listing ORDER BY name LIMIT 5000
""")
def q_move_listing(spark, sf):
    return move_listing(fixtures(spark, sf).listing, 5000, "/data/incoming")


def file_names(keys: DataFrame, files: DataFrame) -> DataFrame:
    """File keys with their short name and the date key of their registration; unknown keys have neither."""
    known = files.select("file_key", "short_filename", key_of("register_datetime").alias("dw_date_key"))
    return keys.select("file_key").join(known, "file_key", "left")


@query("file_names", "2.20", """
SELECT o.o_orderkey * 10 + 1 AS file_key, f.short_filename, strftime(f.register_datetime, '%Y%m%d')::INTEGER AS dw_date_key
FROM orders o LEFT JOIN fx_files f ON f.file_key = o.o_orderkey * 10 + 1
""")
def q_file_names(spark, sf):
    fx = fixtures(spark, sf)
    return file_names(fx.raw("orders").selectExpr("o_orderkey * 10 + 1 AS file_key"), fx.files)


def financial_periods(wanted: DataFrame, periods: DataFrame) -> DataFrame:
    """Wanted (fin_year, period_no, company_code), with whether the calendar has that period."""
    known = periods.select("fin_year", "period_no", "company_code").distinct().withColumn("found", F.lit(True))
    return wanted.join(known, ["fin_year", "period_no", "company_code"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("financial_periods", "2.20", """
SELECT w.*, EXISTS (FROM fx_dim_period p WHERE (p.fin_year, p.period_no, p.company_code) = (w.fin_year, w.period_no, w.company_code)) AS found
FROM (SELECT DISTINCT year(l_shipdate)::INTEGER AS fin_year, month(l_shipdate)::INTEGER AS period_no,
             'C' || (l_suppkey % 4)::VARCHAR AS company_code FROM lineitem) w
""")
def q_financial_periods(spark, sf):
    fx = fixtures(spark, sf)
    wanted = fx.raw("lineitem").selectExpr("CAST(year(l_shipdate) AS INT) AS fin_year", "CAST(month(l_shipdate) AS INT) AS period_no",
                                           "concat('C', CAST(l_suppkey % 4 AS STRING)) AS company_code").distinct()
    return financial_periods(wanted, fx.dim_period)


def parameter_of_today(tasks: DataFrame, task_like: str, as_of: dt.datetime) -> DataFrame:
    """Second half of the daily reset: the parameter text (today's key) of the matching tasks."""
    return tasks.filter(F.col("task").like(task_like)).select("task_id", "task", F.lit(as_of.strftime("%Y%m%d")).alias("diy_parameter"))


@query("parameter_of_today", "D6", "SELECT task_id, task, '20240131' AS diy_parameter FROM fx_tasks WHERE ends_with(task, '12')")
def q_parameter_of_today(spark, sf):
    return parameter_of_today(fixtures(spark, sf).tasks, "%12", AS_OF_RUNS)


def next_tablespace(asked: DataFrame, partitions: DataFrame) -> DataFrame:
    """Space for each asked (owner, table_name, partition_name): that of the table's partition of that day, else of
    the next one after it, else of the last one before it; NULL for a table without dated partitions.

    An as-of look-up: the days of a table's partitions (of several spaces on a
    day the first by name) and its asked days meet in day order, once each, so
    a table with a third of all rows brings a row a day to its task and no more.
    """
    keys = ["owner", "table_name", "day"]
    day = F.try_to_date(F.substring("partition_name", 3, 8), "yyyyMMdd")
    dated = asked.select("owner", "table_name", "partition_name", day.alias("day"))
    calendar = partitions.select("owner", "table_name", day.alias("day"), "tablespace_name").filter(F.col("day").isNotNull()) \
        .groupBy(*keys).agg(F.min("tablespace_name").alias("space"))
    wanted = dated.filter(F.col("day").isNotNull()).select(*keys).distinct().withColumn("space", F.lit(None).cast("string"))
    days = calendar.unionByName(wanted).groupBy(*keys).agg(F.max("space").alias("space"))
    by = Window.partitionBy("owner", "table_name").orderBy("day")
    onward = F.first("space", ignorenulls=True).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    back = F.last("space", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = days.select(*keys, F.coalesce(onward, back).alias("next_tablespace"))
    return dated.join(found, keys, "left").select("owner", "table_name", "partition_name", "next_tablespace")


@query("next_tablespace", "2.20", """
WITH dated AS (
  SELECT owner, table_name, try_strptime(substr(partition_name, 3, 8), '%Y%m%d') AS day, min(tablespace_name) AS space
  FROM fx_partitions GROUP BY ALL HAVING day IS NOT NULL
), asked AS (
  SELECT 'DW' AS owner, substr(index_name, 4) AS table_name,
         'P_' || strftime(try_strptime(substr(partition_name, 3, 8), '%Y%m%d') + INTERVAL 1 DAY, '%Y%m%d') AS partition_name,
         try_strptime(substr(partition_name, 3, 8), '%Y%m%d') + INTERVAL 1 DAY AS day
  FROM fx_ind_parts
)
SELECT asked.owner, asked.table_name, asked.partition_name, ifnull(onward.space, back.space) AS next_tablespace
FROM asked
ASOF LEFT JOIN dated AS onward ON (onward.owner, onward.table_name) = (asked.owner, asked.table_name) AND onward.day >= asked.day
ASOF LEFT JOIN dated AS back ON (back.owner, back.table_name) = (asked.owner, asked.table_name) AND back.day <= asked.day
""")
def q_next_tablespace(spark, sf):
    """Where the day after each index partition goes."""
    fx = fixtures(spark, sf)
    after = F.date_add(F.try_to_date(F.substring("partition_name", 3, 8), "yyyyMMdd"), 1)
    asked = fx.ind_parts.select(F.lit("DW").alias("owner"), F.expr("substring(index_name, 4)").alias("table_name"),
                                F.concat(F.lit("P_"), F.date_format(after, "yyyyMMdd")).alias("partition_name"))
    return next_tablespace(asked, fx.partitions)


# --------------------------------------------------------------------- second outputs
@query("advanced_tasks", "D5", """
WITH own AS (SELECT max(max_key) AS pd FROM fx_tasks WHERE task = 'Customer#000000010'),
     gate AS (SELECT sum(rows_loaded) AS n FROM fx_runs, own WHERE task IN ('Customer#000000011', 'Customer#000000012')
              AND diy_parameter = pd::VARCHAR)
SELECT task_id, task, CASE WHEN task = 'Customer#000000010' AND n >= 1 AND pd < 20240130
                           THEN strftime(strptime(pd::VARCHAR, '%Y%m%d') + INTERVAL 1 DAY, '%Y%m%d')::INTEGER ELSE max_key END AS max_key
FROM fx_tasks, own, gate
""")
def q_advanced_tasks(spark, sf):
    fx = fixtures(spark, sf)
    return advance_watermark(fx.tasks, fx.runs, AS_OF_RUNS, "Customer#000000010",
                             ("Customer#000000011", "Customer#000000012"))[0].select("task_id", "task", "max_key")


_GROUP_PICKED = """
WITH groups AS (SELECT DISTINCT task_id FROM fx_tasks SEMI JOIN (SELECT task_id FROM fx_steps WHERE ends_with(template_name, 'STD_GROUP_TASK')) USING (task_id)
                WHERE starts_with(task, 'Customer#')),
     passed AS (SELECT run_id, batch_id, task_id FROM fx_runs SEMI JOIN groups USING (task_id)
                SEMI JOIN (SELECT batch_id FROM fx_batches WHERE load_status <> 'BATCHED') USING (batch_id) WHERE run_status = 'RUNABLE')
"""


@query("closed_group_batches", "D10", _GROUP_PICKED + """
SELECT batch_id, coalesce(arg_max(passed.task_id, run_id) FILTER (super_batch_ind IN ('C', 'N')), any_value(b.task_id)) AS task_id
FROM fx_batches b LEFT JOIN passed USING (batch_id) GROUP BY batch_id
""")
def q_closed_group_batches(spark, sf):
    fx = fixtures(spark, sf)
    return close_group_runs(fx.tasks, fx.steps, fx.runs, fx.batches, AS_OF_RUNS, "Customer#%")[1].select("batch_id", "task_id")


@query("closed_group_log", "D10", _GROUP_PICKED + """
SELECT task_id, count(run_id) AS updates FROM groups LEFT JOIN passed USING (task_id) GROUP BY task_id
""")
def q_closed_group_log(spark, sf):
    fx = fixtures(spark, sf)
    return close_group_runs(fx.tasks, fx.steps, fx.runs, fx.batches, AS_OF_RUNS, "Customer#%")[2].select("task_id", "updates")


@query("reset_ranges", "D11", """
WITH said AS (SELECT task_id FROM fx_log WHERE process_name = 'DW_KERNEL' AND error_code = 'E'
              AND contains(message, 'partition number is invalid') AND error_sysdate > TIMESTAMP '2024-01-30'),
     hit AS (SELECT DISTINCT task FROM fx_runs SEMI JOIN said USING (task_id) WHERE run_status = 'FAILED' AND starts_with(task, 'Customer#'))
SELECT * REPLACE (if(run_status = 'FAILED' AND task IN (FROM hit), 'RUNABLE', run_status) AS run_status) FROM fx_ranges
""")
def q_reset_ranges(spark, sf):
    fx = fixtures(spark, sf)
    return reset_by_error_log(fx.log, fx.runs, fx.ranges, AS_OF_RUNS, "Customer#%", "%partition number is invalid%", "DW_KERNEL", 1.0)[1]


@query("reset_failed_batches", "D12", """
SELECT * REPLACE (if(load_status = 'AUDITFAILED', 'LOADED', load_status) AS load_status) FROM fx_batches
""")
def q_reset_failed_batches(spark, sf):
    return reset_failed_batches(fixtures(spark, sf).batches)


def _deleted(spark, sf, table: str) -> DataFrame:
    fx = fixtures(spark, sf)
    ids = fx.batches.filter("load_status = 'AUDITFAILED' AND record_count = 0")
    return cascade_delete({"files": fx.files, "runs": fx.runs, "batches": fx.batches}, ids)[table].select(getattr(fx, table).columns)


@query("cascade_delete_runs", "D13", """
SELECT fx_runs.* FROM fx_runs ANTI JOIN (SELECT batch_id FROM fx_batches WHERE record_count = 0 AND load_status = 'AUDITFAILED') AS dead
ON dead.batch_id = fx_runs.batch_id
""")
def q_cascade_delete_runs(spark, sf):
    return _deleted(spark, sf, "runs")


@query("cascade_delete_batches", "D13", "SELECT * FROM fx_batches WHERE NOT ifnull(record_count = 0 AND load_status = 'AUDITFAILED', FALSE)")
def q_cascade_delete_batches(spark, sf):
    return _deleted(spark, sf, "batches")


@query("files_by_name", "F12", "SELECT * FROM fx_files WHERE contains(short_filename, '_1998')")
def q_files_by_name(spark, sf):
    return file_lookup(fixtures(spark, sf).files, name_like="%\\_1998%")


@query("batches_by_status", "B9", "SELECT * FROM fx_batches WHERE load_status = 'PROVISIONED'")
def q_batches_by_status(spark, sf):
    return batch_lookup(fixtures(spark, sf).batches, status="PROVISIONED")


@query("tasks_without_runs_today", "2.12", """
SELECT task_id, task FROM fx_tasks
WHERE (SELECT bool_and(task IS NOT NULL) FROM fx_runs) AND NOT EXISTS (FROM fx_runs r WHERE r.task = fx_tasks.task AND r.diy_parameter = '20240130')
""")
def q_tasks_without_runs_today(spark, sf):
    fx = fixtures(spark, sf)
    return not_in(fx.tasks, "task", fx.runs.filter("diy_parameter = '20240130'"), "task").select("task_id", "task")


@query("files_registered_later", "2.20", """
SELECT file_key FROM fx_files WHERE strftime(register_datetime, '%Y%m%d')::INTEGER > max_dw_date_key
  OR strftime(register_datetime, '%Y%m%d')::INTEGER >= 20011029
""")
def q_files_registered_later(spark, sf):
    f = fixtures(spark, sf).files.select("file_key", key_of("register_datetime").alias("k"), "max_dw_date_key")
    week = int((AS_OF_FILES - dt.timedelta(days=7)).strftime("%Y%m%d"))
    return f.filter((F.col("k") > F.col("max_dw_date_key")) | (F.col("k") >= week)).select("file_key")
