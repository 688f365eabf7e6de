"""Fixture views (fx_*) derived from the driver's tables with Spark.

The operators take load-framework tables (tasks, runs, batches, files, ...).
The driver only ships TPC-H-like tables, so each fx_* view re-labels one of
them with fixed rules (FIXTURES.md part B).  Every view is a lazy projection
or small aggregate of a parquet scan: filters and column pruning reach the
scan, and the work grows with the input tables.

The DuckDB twin of every rule lives in ``fixture_sql.py``; keep both equal.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed clocks of the fixtures (FIXTURES.md part B).
AS_OF_RUNS = dt.datetime(2024, 1, 31, 0, 0, 0)     # events side
AS_OF_FILES = dt.datetime(2001, 11, 5, 0, 0, 0)    # orders / lineitem side

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def task_name(c: str) -> str:
    return f"concat('Customer#', lpad(CAST({c} AS STRING), 9, '0'))"


class Fixtures:
    """Lazily built fx_* DataFrames for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def get(self, name: str) -> DataFrame:
        return getattr(self, name.removeprefix("fx_"))

    def register_views(self, names=None) -> None:
        for n in names or FX_NAMES:
            self.get(n).createOrReplaceTempView(n)

    # -- events side -----------------------------------------------------
    @cached_property
    def ev(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id", "ts", "user_id", "event_type", "value",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k")

    @cached_property
    def runs(self) -> DataFrame:
        return self.ev.selectExpr(*self._run_exprs())

    @staticmethod
    def _run_exprs() -> list[str]:
        return [
            "event_id AS run_id", "user_id AS task_id", "event_id * 2 - event_id % 2 AS batch_id",
            f"{task_name('user_id')} AS task",
            """CASE WHEN event_type = 'view' AND k % 9 = 0 THEN 'CANCELLED'
                    WHEN event_type = 'view' THEN 'CLOSED'
                    WHEN event_type = 'purchase' THEN 'SUCCESS'
                    WHEN event_type = 'error' THEN 'FAILED'
                    WHEN event_type = 'signup' THEN 'RUNNING'
                    WHEN k % 5 = 0 THEN 'WAITING'
                    WHEN k % 5 = 1 THEN 'PENDING'
                    ELSE 'RUNABLE' END AS run_status""",
            "ts AS start_date",
            """CASE WHEN event_type IN ('view', 'purchase', 'error')
                    THEN timestampadd(MICROSECOND, CAST(round(value * 1000000) AS BIGINT), ts)
                    END AS end_date""",
            "CASE WHEN event_type <> 'click' THEN k * 1000 END AS rows_loaded",
            "CASE WHEN event_type = 'error' THEN k ELSE CAST(0 AS BIGINT) END AS rows_error",
            "CASE WHEN event_type <> 'click' THEN k * 600 END AS rows_inserted",
            "CASE WHEN event_type <> 'click' THEN k * 400 END AS rows_updated",
            "date_format(ts, 'yyyyMMdd') AS diy_parameter",
            "CASE WHEN event_type = 'signup' THEN concat('BEGIN dw_load(', CAST(k AS STRING), '); END;') END AS direct_exec_sql",
            "event_type AS remark"]

    @cached_property
    def ranges(self) -> DataFrame:
        # Same rules as runs, computed from the one events scan (no self join).
        return self.ev.selectExpr(*self._run_exprs(), "k AS __k").selectExpr(
            "run_id div 4 AS run_id", "task", "run_status", "start_date", "end_date", "__k * 1000 AS rows_loaded")

    @cached_property
    def log(self) -> DataFrame:
        return self.ev.selectExpr(
            "event_id AS log_id", "user_id AS task_id", "event_id div 3 AS run_id", "event_id AS batch_id",
            "CASE WHEN event_type = 'error' THEN 'DW_KERNEL' ELSE 'DW_FILE_TASK_REGISTER' END AS process_name",
            """CASE WHEN event_type = 'view' AND k % 4 = 0
                      THEN concat('  Concatenating DAT File for run ', CAST(event_id div 3 AS STRING))
                    WHEN event_type = 'purchase' AND k % 4 = 0
                      THEN concat('  Concatenated DAT File Created: f', CAST(k AS STRING), '.dat')
                    WHEN event_type = 'signup' AND k % 4 = 0
                      THEN concat('1-2) STEP END ', CAST(k % 7 + 1 AS STRING), ' secs ', CAST(k * 100 AS STRING), ' rows')
                    WHEN event_type = 'view' THEN 'Task: TF_START'
                    WHEN event_type = 'click' THEN concat('Do_Batch_Move: Move Success Update activity count: ', CAST(k AS STRING))
                    WHEN event_type = 'signup' THEN concat('LoadGlobalFileTable_DoBatch: Success - rowcount: ', CAST(k AS STRING))
                    WHEN event_type = 'purchase' THEN 'END: File Task Register'
                    ELSE 'The partition number is invalid or out-of-range' END AS message""",
            "CASE WHEN event_type = 'error' THEN 'E' ELSE 'I' END AS error_code",
            "ts AS error_sysdate",
            f"{task_name('user_id')} AS id_1",
            "concat(CAST(user_id AS STRING), '-', date_format(ts, 'yyyyMMdd')) AS id_2",
            "CAST(k AS STRING) AS id_3",
            "concat(CAST(1 + user_id % 2 AS STRING), '-', CAST(user_id AS STRING)) AS id_4",
            "user_id AS sid",
            "CAST(1 + user_id % 2 AS BIGINT) AS inst_id")

    @cached_property
    def ctl(self) -> DataFrame:
        return self.ev.selectExpr(
            "event_type AS source_system_cd", "event_id AS batch_id", "ts AS start_time",
            "CASE WHEN k % 10 = 0 THEN 'S2S_F' WHEN k % 10 = 1 THEN 'S2S_P' ELSE 'S2S_C' END AS process_status",
            "ts - INTERVAL 1 DAY AS min_date_ts", "ts AS max_date_ts")

    @cached_property
    def job_ctl(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "concat(event_type, '_', CAST(event_id % 3 AS STRING)) AS record_set",
            "CAST(to_date(ts) AS TIMESTAMP_NTZ) AS min_date_ts",
            "CAST(to_date(ts) AS TIMESTAMP_NTZ) + INTERVAL 1 DAY AS max_date_ts")

    @cached_property
    def rated(self) -> DataFrame:
        return (self.raw("events").filter("event_type = 'purchase'")
                .selectExpr("event_id AS batch_id", "event_type AS source_system_cd"))

    @cached_property
    def sessions(self) -> DataFrame:
        return self.ev.selectExpr(
            "CAST(1 + user_id % 2 AS BIGINT) AS inst_id", "event_id AS sid", "user_id AS serial",
            "concat('U', CAST(user_id AS STRING)) AS username",
            "concat('MOD_', event_type) AS module",
            "concat('ACT_', CAST(k % 5 AS STRING)) AS action",
            # Sessions of little work name no run: their text has no space after the tag.
            "concat('DW_RUN_ID=', CASE WHEN value >= 20 THEN concat(CAST(event_id AS STRING), ' X') ELSE 'NONE' END) AS client_info",
            "CASE WHEN event_type = 'error' THEN 'enq: TX - row lock contention' ELSE 'db file sequential read' END AS event",
            "CASE WHEN event_type IN ('click', 'signup') THEN 'ACTIVE' ELSE 'INACTIVE' END AS status",
            "CAST(k % 50 AS STRING) AS sql_id",
            "ts AS logon_time", "ts AS sql_exec_start",
            "k AS seconds_in_wait",
            "CASE WHEN event_type = 'error' THEN event_id - 1 END AS blocking_session")

    @cached_property
    def locks(self) -> DataFrame:
        return self.ev.filter("event_type IN ('error', 'click')").selectExpr(
            # Resources grow with the data: each is shared by at most 16 neighbouring events.
            "event_id AS sid", "event_id div 16 AS id1", "CAST(dayofmonth(ts) AS BIGINT) AS id2",
            "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS block",
            "CASE WHEN event_type = 'click' THEN 6 ELSE 0 END AS request",
            "CASE WHEN event_type = 'error' THEN 6 ELSE 0 END AS lmode",
            "'TX' AS type")

    @cached_property
    def locked_objects(self) -> DataFrame:
        return self.ev.filter("event_type IN ('error', 'click')").selectExpr(
            "k AS object_id", "event_id AS session_id",
            "CASE WHEN event_type = 'error' THEN 6 ELSE 3 END AS locked_mode",
            "concat('U', CAST(user_id AS STRING)) AS oracle_username")

    @cached_property
    def ddl_locks(self) -> DataFrame:
        return self.raw("events").filter("event_type IN ('signup', 'purchase')").selectExpr(
            "event_id AS session_id", "'DW' AS owner", f"{task_name('user_id')} AS name",
            "'Table/Procedure/Type' AS type",
            "CASE WHEN event_type = 'signup' THEN 'Exclusive' ELSE 'Share' END AS mode_held")

    @cached_property
    def longops(self) -> DataFrame:
        op = """CASE event_type WHEN 'view' THEN 'Sort Output' WHEN 'click' THEN 'Hash Join'
                WHEN 'signup' THEN 'Table Scan' WHEN 'purchase' THEN 'Insert'
                ELSE 'Index Fast Full Scan' END"""
        return self.ev.selectExpr(
            "CAST(1 + user_id % 2 AS BIGINT) AS inst_id", "event_id AS sid", "user_id AS serial",
            f"{op} AS opname",
            f"concat({op}, ': T_', CAST(k AS STRING)) AS message",
            "concat('T_', CAST(k AS STRING)) AS target",
            "CASE WHEN event_type IN ('view', 'purchase') THEN 'Rows' ELSE 'Blocks' END AS units",
            "CAST(floor(value) AS BIGINT) AS sofar",
            "CAST(floor(value) AS BIGINT) + k AS totalwork",
            "k AS elapsed_seconds", "k % 7 AS time_remaining",
            "CAST(k % 50 AS STRING) AS sql_id",
            "ts AS start_time")

    @cached_property
    def audit(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "concat('U', CAST(user_id AS STRING)) AS username", f"{task_name('user_id')} AS obj_name",
            "CASE event_type WHEN 'error' THEN 'DROP' WHEN 'signup' THEN 'CREATE' ELSE 'ALTER' END AS action_name",
            "ts AS event_time")

    # -- customer side ---------------------------------------------------
    @cached_property
    def tasks(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS task_id", "c_name AS task",
            "CAST(20240125 + c_custkey % 6 AS INT) AS max_key",
            "CASE WHEN c_custkey % 5 = 0 THEN 'No' ELSE 'Yes' END AS is_runnable",
            "CASE WHEN c_custkey % 3 = 0 THEN 'FILE' ELSE 'EXEC' END AS task_type",
            "CASE c_custkey % 3 WHEN 0 THEN 'LOAD' WHEN 1 THEN 'BATCH' ELSE 'DIY' END AS parameter_type",
            "c_mktsegment AS task_business_area",
            "concat('AREA_', CAST(c_nationkey AS STRING)) AS task_technical_area",
            "CASE WHEN c_nationkey % 2 = 0 THEN 'TABLE' ELSE 'VIEW' END AS task_target_type",
            "concat('SRC', CAST(c_custkey % 4 AS STRING)) AS source_system",
            f"CASE WHEN c_custkey = 0 THEN 'Pattern task' ELSE {task_name('c_custkey - 1')} END AS pattern_task",
            "CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS copy_batch_ind",
            "CASE WHEN c_custkey % 7 = 0 THEN 'Y' ELSE 'N' END AS super_batch_ind",
            "CAST(c_custkey % 8 + 1 AS BIGINT) AS max_file_load_concurrency",
            "concat('P', CAST(c_custkey % 3 AS STRING)) AS flex1",
            "concat('node', CAST(c_custkey % 4 + 1 AS STRING)) AS flex2")

    @cached_property
    def steps(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS task_id", "c_name AS task",
            "concat('SRC.T', CAST(c_custkey % 9 AS STRING)) AS source_table",
            "concat('S.Brand#', CAST(1 + c_custkey % 25 AS STRING)) AS target_table_name",
            "CASE c_custkey % 4 WHEN 0 THEN 'STD_PARTSWAP' WHEN 1 THEN 'STD_GROUP_TASK' ELSE 'STD_LOAD' END AS template_name")

    # -- orders side -----------------------------------------------------
    @cached_property
    def batches(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS batch_id", "o_custkey AS task_id",
            "concat('STG.', o_orderpriority) AS table_name",
            "CAST(date_format(o_orderdate, 'yyyyMMdd') AS INT) AS dw_date_key",
            "CAST(date_format(o_orderdate, 'yyyyMMdd') AS INT) AS dw_max_date_key",
            """CASE WHEN o_orderstatus = 'F' THEN 'AUDITFAILED'
                    WHEN o_orderstatus = 'P' THEN 'PROVISIONED'
                    WHEN o_orderkey % 4 = 0 THEN 'AUDITING'
                    WHEN o_orderkey % 4 = 1 THEN 'LOADED'
                    WHEN o_orderkey % 4 = 2 THEN 'BATCHED'
                    ELSE 'AUDITED' END AS load_status""",
            """CASE WHEN o_orderkey % 11 = 0 THEN CAST(0 AS BIGINT)
                    WHEN o_orderkey % 13 = 0 THEN CAST(-2 AS BIGINT)
                    ELSE CAST(floor(o_totalprice) AS BIGINT) END AS record_count""",
            "CASE WHEN o_orderkey % 10 = 0 THEN 'Y' WHEN o_orderkey % 10 = 1 THEN 'C' ELSE 'N' END AS super_batch_ind",
            "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS super_batch_id",
            "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 END AS copied_batch_id",
            "o_orderdate AS create_datetime", "o_orderdate AS audit_start_date",
            "o_orderdate + INTERVAL 1 HOUR AS load_start_date")

    def _job_name(self) -> str:
        return "concat('JOB#', CAST(o_custkey AS STRING), '#', CAST(o_orderkey AS STRING))"

    @cached_property
    def jobs(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "'DW' AS owner", f"{self._job_name()} AS job_name",
            "CASE o_orderstatus WHEN 'F' THEN 'DISABLED' WHEN 'O' THEN 'RUNNING' ELSE 'SCHEDULED' END AS state",
            "o_orderdate AS last_start_date")

    @cached_property
    def running_jobs(self) -> DataFrame:
        return self.raw("orders").filter("o_orderstatus = 'O'").selectExpr(
            "'DW' AS owner", f"{self._job_name()} AS job_name", "o_orderkey % 150 AS session_id")

    @cached_property
    def scheduled_jobs(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            f"{self._job_name()} AS job_name",
            "CASE o_orderstatus WHEN 'F' THEN 'DISABLED' WHEN 'O' THEN 'RUNNING' ELSE 'SCHEDULED' END AS job_status")

    @cached_property
    def job_log(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS log_id", "o_orderdate AS log_date", "'DW' AS owner",
            f"{self._job_name()} AS job_name",
            "CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status")

    @cached_property
    def job_details(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS log_id",
            """concat('ORA-', lpad(CAST(o_orderkey % 1000 AS STRING), 5, '0'), ': job for customer ',
                      CAST(o_custkey AS STRING), ' priority ', o_orderpriority,
                      ' stopped; see the scheduler log for the full stack of the failing statement and its binds')
               AS additional_info""")

    @cached_property
    def queue(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "'MAINT' AS queue_name", "o_orderpriority AS op",
            "concat('Brand#', CAST(1 + o_orderkey % 25 AS STRING)) AS segment_name",
            "concat('P_', date_format(o_orderdate, 'yyyyMMdd')) AS partition_name",
            "concat('P_', date_format(o_orderdate, 'yyyyMMdd'), '_S', CAST(o_orderkey % 4 AS STRING)) AS subpartition_name",
            """CASE WHEN o_orderkey % 3 = 0 THEN 'done'
                    WHEN o_orderstatus = 'F' THEN 'FAIL'
                    WHEN o_orderstatus = 'O' THEN 'BUSY'
                    ELSE 'ready' END AS status""",
            "CAST(floor(o_totalprice) AS DOUBLE) AS sizmb",
            "CAST(o_orderkey AS DOUBLE) AS gboffset",
            "o_orderdate AS start_date",
            "CAST(1 + (o_custkey % 150) % 2 AS BIGINT) AS inst_id",
            "o_custkey % 150 AS sid")

    @cached_property
    def dim_period(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "CAST(year(o_orderdate) AS INT) AS fin_year", "CAST(month(o_orderdate) AS INT) AS period_no",
            "concat('C', CAST(o_custkey % 3 AS STRING)) AS company_code").distinct()

    # -- lineitem side ---------------------------------------------------
    @cached_property
    def files(self) -> DataFrame:
        li = self.raw("lineitem").selectExpr(
            "*",
            """concat('F', CAST(l_suppkey AS STRING), '_', date_format(l_shipdate, 'yyyyMMdd'), '_',
                      CAST(l_linenumber AS STRING), '.dat') AS short_filename""",
            "concat('/data/', CAST(l_suppkey AS STRING), '/incoming') AS path")
        return li.selectExpr(
            "l_orderkey * 10 + l_linenumber AS file_key", "l_suppkey AS task_id", "l_orderkey AS batch_id",
            "concat(path, '/', short_filename) AS filename", "short_filename", "path",
            """CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'ARCHFAILED'
                    WHEN l_returnflag = 'A' THEN 'ARCHIVED'
                    WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'DUPLICATE'
                    WHEN l_returnflag = 'R' AND l_linenumber = 6 THEN 'BATCHED'
                    WHEN l_returnflag = 'R' THEN 'REGISTERED'
                    WHEN l_linestatus = 'F' THEN 'ARCHIVING'
                    WHEN l_linenumber = 5 THEN 'FAILED'
                    ELSE 'LOADED' END AS processing_status""",
            "CAST(floor(l_quantity) AS BIGINT) AS row_count",
            "CAST(floor(l_quantity) AS BIGINT) - CAST(round(l_discount * 100) AS BIGINT) AS base_row_count",
            "CAST(round(l_discount * 100) AS BIGINT) AS bad_row_count",
            "CAST(round(l_tax * 100) AS BIGINT) AS log_errors_row_count",
            "CAST(date_format(l_shipdate, 'yyyyMMdd') AS INT) AS max_dw_date_key",
            "l_shipdate AS register_datetime",
            "CASE WHEN l_returnflag <> 'R' THEN timestampadd(HOUR, l_linenumber, l_shipdate) END AS start_datetime",
            "md5(short_filename) AS md5_checksum",
            "l_linenumber AS line_no")

    @cached_property
    def processed_files(self) -> DataFrame:
        return self.files.selectExpr(
            "concat('SRC', CAST(task_id % 4 AS STRING)) AS source_system_cd", "short_filename AS filename",
            "row_count AS record_count", "register_datetime AS processed_date")

    @cached_property
    def listing(self) -> DataFrame:
        return (self.files.groupBy("short_filename")
                .agg(F.max("register_datetime").alias("modification_time"),
                     F.sum("row_count").alias("length"))
                .withColumnRenamed("short_filename", "name"))

    @cached_property
    def manifest(self) -> DataFrame:
        # Every registered name, and the header file of each stream, which none delivers.
        headers = self.raw("supplier").selectExpr("concat('F', CAST(s_suppkey AS STRING), '_HEADER.dat') AS name")
        return self.files.select(F.col("short_filename").alias("name")).union(headers).distinct()

    @cached_property
    def staging(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS batch_id", "l_returnflag AS record_type",
            "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_linestatus END AS code",
            "l_partkey AS item_key")

    @cached_property
    def errors(self) -> DataFrame:
        a = self.log.filter("error_code = 'E'").selectExpr(
            "'ERR_RUNS' AS table_name", "message AS err_message", "error_sysdate AS insert_date")
        b = self.files.selectExpr(
            "'ERR_FILES' AS table_name", "concat('BAD ROWS IN ', processing_status) AS err_message",
            "register_datetime AS insert_date")
        return a.unionByName(b)

    @cached_property
    def sql(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "CAST(1 + l_suppkey % 2 AS BIGINT) AS inst_id", "CAST(l_partkey AS STRING) AS sql_id",
            "concat('SELECT /* part ', CAST(l_partkey AS STRING), ' */ * FROM FCT_', CAST(l_partkey % 100 AS STRING)) AS sql_text",
            "CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS cpu_time",
            "CAST(floor(l_extendedprice) AS BIGINT) * 2000 AS elapsed_time",
            "l_suppkey AS disk_reads",
            "CAST(floor(l_extendedprice) AS BIGINT) AS buffer_gets",
            "CAST(l_linenumber AS BIGINT) AS executions",
            "CAST(floor(l_quantity) AS BIGINT) % 10 AS rows_processed")

    @cached_property
    def sqltext(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "CAST(1 + l_suppkey % 2 AS BIGINT) AS inst_id", "CAST(l_partkey AS STRING) AS sql_id", "CAST(l_linenumber - 1 AS BIGINT) AS piece",
            "concat('piece ', CAST(l_linenumber AS STRING), ' of ', CAST(l_orderkey AS STRING)) AS sql_text")

    @cached_property
    def stats(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "CAST(1 + l_suppkey % 2 AS BIGINT) AS inst_id", "l_suppkey AS sid",
            "CAST(l_linenumber AS BIGINT) AS statistic", "l_quantity AS value")

    @cached_property
    def stat_names(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "CAST(l_linenumber AS BIGINT) AS statistic",
            "concat('stat_', CAST(l_linenumber AS STRING)) AS name").distinct()

    # -- part / supplier / nation side -----------------------------------
    def _part_day(self) -> str:
        return "date_add(DATE'2016-01-01', CAST(p_partkey % 365 AS INT))"

    @cached_property
    def metadata(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "'S' AS schema_name", "p_brand AS table_name",
            # try_cast: Catalyst may re-apply this rule to values joined on table_name.
            "CASE WHEN try_cast(substr(p_brand, 7) AS INT) % 2 = 0 THEN 'Batch' ELSE 'Date' END AS partitioning_key",
            "try_cast(substr(p_brand, 7) AS INT) AS retention_value",
            "concat('TS_', p_brand) AS tablespace_variable").distinct()

    @cached_property
    def segments(self) -> DataFrame:
        d = "date_add(DATE'1995-01-01', CAST(p_partkey % 2400 AS INT))"
        return self.raw("part").selectExpr(
            "'DW' AS owner", "p_brand AS segment_name",
            f"concat('P_', date_format({d}, 'yyyyMMdd'), '_S', CAST(p_partkey % 4 AS STRING)) AS partition_name",
            f"concat('P_', date_format({d}, 'yyyyMMdd'), '_S', CAST(p_partkey % 4 AS STRING)) AS subpartition_name",
            "'TABLE SUBPARTITION' AS segment_type", "p_type AS tablespace_name",
            "CAST(p_size AS BIGINT) * 1073741824 AS bytes")

    @cached_property
    def partitions(self) -> DataFrame:
        d = self._part_day()
        shifted = ("date_add(DATE'2016-01-01', CAST(p_partkey % 365 - "
                   "CASE WHEN p_partkey % 17 = 0 THEN 40 ELSE 0 END AS INT))")
        return self.raw("part").selectExpr(
            "'DW' AS owner", "p_brand AS table_name",
            f"""CASE WHEN p_partkey % 23 = 0 THEN concat('P_', date_format({d}, 'yyyyMM'), '00')
                     ELSE concat('P_', date_format({d}, 'yyyyMMdd')) END AS partition_name""",
            f"concat('P_', date_format({d}, 'yyyyMMdd'), '_S', CAST(p_partkey % 4 AS STRING)) AS subpartition_name",
            f"concat('TS_', date_format({shifted}, 'yyyyMM')) AS tablespace_name",
            "'USABLE' AS status", "p_partkey AS object_id")

    @cached_property
    def batch_parts(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "'STG_GEN' AS table_owner", "concat('Brand#', CAST(1 + o_orderkey % 25 AS STRING)) AS table_name",
            "concat('P_', CAST(o_orderkey AS STRING)) AS partition_name",
            "CASE WHEN o_orderkey % 9 = 0 THEN 'TS_OTHER' ELSE 'TS_STG_GEN' END AS tablespace_name")

    @cached_property
    def ind_parts(self) -> DataFrame:
        d = self._part_day()
        return self.raw("part").selectExpr(
            "'DW' AS index_owner", "concat('UK_', p_brand) AS index_name",
            f"concat('P_', date_format({d}, 'yyyyMMdd')) AS partition_name",
            f"concat('P_', date_format({d}, 'yyyyMMdd'), '_S', CAST(p_partkey % 4 AS STRING)) AS subpartition_name",
            "CASE WHEN p_size % 10 = 0 THEN 'UNUSABLE' ELSE 'USABLE' END AS part_status",
            "CASE WHEN p_size % 7 = 0 THEN 'UNUSABLE' ELSE 'USABLE' END AS subpart_status",
            f"concat('TS_', date_format({d}, 'yyyyMM')) AS tablespace_name")

    @cached_property
    def indexes(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "'DW' AS owner", "concat('UK_', p_brand) AS index_name", "p_brand AS table_name",
            "CASE WHEN try_cast(substr(p_brand, 7) AS INT) % 5 = 0 THEN 'UNUSABLE' ELSE 'VALID' END AS status"
        ).distinct()

    @cached_property
    def types(self) -> DataFrame:
        # Distinct part types are a handful of rows: a global numbering is fine.
        from pyspark.sql import Window
        t = self.raw("part").select("p_type").distinct()
        return t.withColumn("type_no", (F.row_number().over(Window.orderBy("p_type")) - 1).cast("long"))

    @cached_property
    def free(self) -> DataFrame:
        s = self.raw("supplier")
        return (s.join(F.broadcast(self.types), (s.s_suppkey % 6) == F.col("type_no"))
                .selectExpr("p_type AS tablespace_name", "s_suppkey AS file_id",
                            "CAST(floor(abs(s_acctbal)) AS BIGINT) * 1048576 AS bytes"))

    @cached_property
    def datafiles(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_type AS tablespace_name", "p_partkey AS file_id",
            "concat('/u01/', lower(p_type), '_', CAST(p_partkey AS STRING), '.dbf') AS file_name",
            "CAST(p_size AS BIGINT) * 1073741824 AS bytes",
            "CASE WHEN p_size % 2 = 0 THEN 'YES' ELSE 'NO' END AS autoextensible",
            "CAST(p_size AS BIGINT) * 2147483648 AS maxbytes")

    @cached_property
    def spaces(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_type AS tablespace_name",
            "CASE WHEN p_type = 'LARGE' THEN 'YES' ELSE 'NO' END AS bigfile",
            "'ONLINE' AS status").distinct()

    @cached_property
    def temp(self) -> DataFrame:
        s = self.raw("supplier").selectExpr(
            "concat('TEMP', CAST(s_nationkey % 3 AS STRING)) AS tablespace_name",
            "floor(abs(s_acctbal)) AS mb")
        return s.groupBy("tablespace_name").agg(
            (F.sum("mb").cast("long") * 4194304).alias("tablespace_size"),
            (F.sum("mb").cast("long") * 2097152).alias("allocated_space"),
            (F.sum("mb").cast("long") * 1048576).alias("free_space"))

    @cached_property
    def disk_groups(self) -> DataFrame:
        s = self.raw("supplier")
        return s.groupBy("s_nationkey").agg(
            (F.sum(F.ceil(F.abs("s_acctbal"))).cast("long") * 2).alias("total_mb"),
            F.sum(F.floor(F.abs("s_acctbal"))).cast("long").alias("free_mb"),
            F.expr("CAST(sum(floor(abs(s_acctbal))) AS BIGINT) div 2").alias("usable_file_mb"),
        ).select(F.col("s_nationkey").cast("string").alias("name"), "total_mb", "free_mb", "usable_file_mb")

    @cached_property
    def objects(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS object_id", "'DW' AS owner",
            "concat('T_', CAST(p_partkey AS STRING)) AS object_name", "'TABLE' AS object_type")

    @cached_property
    def control(self) -> DataFrame:
        n = self.raw("nation").select("n_name", "n_nationkey", "n_regionkey",
                                      F.explode(F.sequence(F.lit(1), F.lit(30))).alias("i"))
        # Each region's nations skip one weekday (Monday = 0 for region 0, ...).
        return n.filter("weekday(date_add(DATE'2024-01-01', i - 1)) <> n_regionkey").selectExpr(
            "n_name AS object_name",
            "CAST(date_format(date_add(DATE'2024-01-01', i - 1), 'yyyyMMdd') AS INT) AS date_key",
            "CASE n_nationkey % 3 WHEN 0 THEN 'LOADED' WHEN 1 THEN 'LOADING' ELSE 'FAILED' END AS processing_status")


FX_NAMES = [
    "fx_tasks", "fx_runs", "fx_ranges", "fx_log", "fx_batches", "fx_files", "fx_steps",
    "fx_metadata", "fx_control", "fx_ctl", "fx_job_ctl", "fx_rated", "fx_processed_files",
    "fx_jobs", "fx_running_jobs", "fx_scheduled_jobs", "fx_job_log", "fx_job_details",
    "fx_segments", "fx_partitions", "fx_ind_parts", "fx_indexes", "fx_free", "fx_datafiles",
    "fx_spaces", "fx_temp", "fx_disk_groups", "fx_queue", "fx_sessions", "fx_locks",
    "fx_locked_objects", "fx_objects", "fx_ddl_locks", "fx_longops", "fx_sql", "fx_sqltext",
    "fx_stats", "fx_stat_names", "fx_listing", "fx_manifest", "fx_audit", "fx_staging",
    "fx_errors", "fx_dim_period", "fx_batch_parts",
]


_CACHE: dict = {}


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    """One ``Fixtures`` per (session, directory), so plans share scans."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = Fixtures(spark, sf_dir)
    return _CACHE[key]
