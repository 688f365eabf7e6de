"""DuckDB twin of ``fixtures.py``: the fx_* views as SQL over the driver tables.

``with_fixtures(sql)`` prefixes a query with exactly the fx_* CTEs it uses
(and their dependencies), so each oracle query is self-contained and runs
on the driver's pre-registered views (region, nation, customer, ...).
The rules here must stay identical to the Spark builders in fixtures.py.
"""

from __future__ import annotations

import re

TASK_NAME = "'Customer#' || lpad(CAST({c} AS VARCHAR), 9, '0')"

FX: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def _fx(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    FX[name] = sql
    DEPS[name] = list(deps)


_fx("fx_ev", """
SELECT event_id, ts, user_id, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events""")

_fx("fx_tasks", f"""
SELECT c_custkey AS task_id, c_name AS task,
       CAST(20240125 + c_custkey % 6 AS INTEGER) AS max_key,
       CASE WHEN c_custkey % 5 = 0 THEN 'No' ELSE 'Yes' END AS is_runnable,
       CASE WHEN c_custkey % 3 = 0 THEN 'FILE' ELSE 'EXEC' END AS task_type,
       CASE c_custkey % 3 WHEN 0 THEN 'LOAD' WHEN 1 THEN 'BATCH' ELSE 'DIY' END AS parameter_type,
       c_mktsegment AS task_business_area,
       'AREA_' || CAST(c_nationkey AS VARCHAR) AS task_technical_area,
       CASE WHEN c_nationkey % 2 = 0 THEN 'TABLE' ELSE 'VIEW' END AS task_target_type,
       'SRC' || CAST(c_custkey % 4 AS VARCHAR) AS source_system,
       CASE WHEN c_custkey = 0 THEN 'Pattern task'
            ELSE {TASK_NAME.format(c='c_custkey - 1')} END AS pattern_task,
       CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS copy_batch_ind,
       CASE WHEN c_custkey % 7 = 0 THEN 'Y' ELSE 'N' END AS super_batch_ind,
       CAST(c_custkey % 8 + 1 AS BIGINT) AS max_file_load_concurrency,
       'P' || CAST(c_custkey % 3 AS VARCHAR) AS flex1,
       'node' || CAST(c_custkey % 4 + 1 AS VARCHAR) AS flex2
FROM customer""")

_fx("fx_runs", f"""
SELECT event_id AS run_id, user_id AS task_id, event_id * 2 - event_id % 2 AS batch_id,
       {TASK_NAME.format(c='user_id')} AS task,
       CASE WHEN event_type = 'view' AND k % 9 = 0 THEN 'CANCELLED'
            WHEN event_type = 'view' THEN 'CLOSED'
            WHEN event_type = 'purchase' THEN 'SUCCESS'
            WHEN event_type = 'error' THEN 'FAILED'
            WHEN event_type = 'signup' THEN 'RUNNING'
            WHEN k % 5 = 0 THEN 'WAITING'
            WHEN k % 5 = 1 THEN 'PENDING'
            ELSE 'RUNABLE' END AS run_status,
       ts AS start_date,
       CASE WHEN event_type IN ('view', 'purchase', 'error')
            THEN ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS end_date,
       CASE WHEN event_type <> 'click' THEN k * 1000 END AS rows_loaded,
       CASE WHEN event_type = 'error' THEN k ELSE 0 END AS rows_error,
       CASE WHEN event_type <> 'click' THEN k * 600 END AS rows_inserted,
       CASE WHEN event_type <> 'click' THEN k * 400 END AS rows_updated,
       strftime(ts, '%Y%m%d') AS diy_parameter,
       CASE WHEN event_type = 'signup' THEN 'BEGIN dw_load(' || CAST(k AS VARCHAR) || '); END;' END AS direct_exec_sql,
       event_type AS remark
FROM fx_ev""", ("fx_ev",))

_fx("fx_ranges", """
SELECT run_id // 4 AS run_id, task, run_status, start_date, end_date,
       k * 1000 AS rows_loaded
FROM (SELECT r.*, e.k FROM fx_runs r JOIN fx_ev e ON r.run_id = e.event_id)""",
    ("fx_runs", "fx_ev"))

_fx("fx_log", f"""
SELECT event_id AS log_id, user_id AS task_id, event_id // 3 AS run_id, event_id AS batch_id,
       CASE WHEN event_type = 'error' THEN 'DW_KERNEL' ELSE 'DW_FILE_TASK_REGISTER' END AS process_name,
       CASE WHEN event_type = 'view' AND k % 4 = 0 THEN '  Concatenating DAT File for run ' || CAST(event_id // 3 AS VARCHAR)
            WHEN event_type = 'purchase' AND k % 4 = 0 THEN '  Concatenated DAT File Created: f' || CAST(k AS VARCHAR) || '.dat'
            WHEN event_type = 'signup' AND k % 4 = 0
              THEN '1-2) STEP END ' || CAST(k % 7 + 1 AS VARCHAR) || ' secs ' || CAST(k * 100 AS VARCHAR) || ' rows'
            WHEN event_type = 'view' THEN 'Task: TF_START'
            WHEN event_type = 'click' THEN 'Do_Batch_Move: Move Success Update activity count: ' || CAST(k AS VARCHAR)
            WHEN event_type = 'signup' THEN 'LoadGlobalFileTable_DoBatch: Success - rowcount: ' || CAST(k AS VARCHAR)
            WHEN event_type = 'purchase' THEN 'END: File Task Register'
            ELSE 'The partition number is invalid or out-of-range' END AS message,
       CASE WHEN event_type = 'error' THEN 'E' ELSE 'I' END AS error_code,
       ts AS error_sysdate,
       {TASK_NAME.format(c='user_id')} AS id_1,
       CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS id_2,
       CAST(k AS VARCHAR) AS id_3,
       CAST(1 + user_id % 2 AS VARCHAR) || '-' || CAST(user_id AS VARCHAR) AS id_4,
       user_id AS sid,
       CAST(1 + user_id % 2 AS BIGINT) AS inst_id
FROM fx_ev""", ("fx_ev",))

_fx("fx_batches", """
SELECT o_orderkey AS batch_id, o_custkey AS task_id,
       'STG.' || o_orderpriority AS table_name,
       CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS dw_date_key,
       CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS dw_max_date_key,
       CASE WHEN o_orderstatus = 'F' THEN 'AUDITFAILED'
            WHEN o_orderstatus = 'P' THEN 'PROVISIONED'
            WHEN o_orderkey % 4 = 0 THEN 'AUDITING'
            WHEN o_orderkey % 4 = 1 THEN 'LOADED'
            WHEN o_orderkey % 4 = 2 THEN 'BATCHED'
            ELSE 'AUDITED' END AS load_status,
       CASE WHEN o_orderkey % 11 = 0 THEN 0
            WHEN o_orderkey % 13 = 0 THEN -2
            ELSE CAST(floor(o_totalprice) AS BIGINT) END AS record_count,
       CASE WHEN o_orderkey % 10 = 0 THEN 'Y' WHEN o_orderkey % 10 = 1 THEN 'C' ELSE 'N' END AS super_batch_ind,
       CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS super_batch_id,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 END AS copied_batch_id,
       o_orderdate AS create_datetime,
       o_orderdate AS audit_start_date,
       o_orderdate + INTERVAL 1 HOUR AS load_start_date
FROM orders""")

_fx("fx_files", """
SELECT l_orderkey * 10 + l_linenumber AS file_key, l_suppkey AS task_id, l_orderkey AS batch_id,
       path || '/' || short_filename AS filename, short_filename, path,
       CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'ARCHFAILED'
            WHEN l_returnflag = 'A' THEN 'ARCHIVED'
            WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'DUPLICATE'
            WHEN l_returnflag = 'R' AND l_linenumber = 6 THEN 'BATCHED'
            WHEN l_returnflag = 'R' THEN 'REGISTERED'
            WHEN l_linestatus = 'F' THEN 'ARCHIVING'
            WHEN l_linenumber = 5 THEN 'FAILED'
            ELSE 'LOADED' END AS processing_status,
       CAST(floor(l_quantity) AS BIGINT) AS row_count,
       CAST(floor(l_quantity) AS BIGINT) - CAST(round(l_discount * 100) AS BIGINT) AS base_row_count,
       CAST(round(l_discount * 100) AS BIGINT) AS bad_row_count,
       CAST(round(l_tax * 100) AS BIGINT) AS log_errors_row_count,
       CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS max_dw_date_key,
       l_shipdate AS register_datetime,
       CASE WHEN l_returnflag <> 'R' THEN l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) END AS start_datetime,
       md5(short_filename) AS md5_checksum,
       l_linenumber AS line_no
FROM (SELECT *,
             'F' || CAST(l_suppkey AS VARCHAR) || '_' || strftime(l_shipdate, '%Y%m%d') || '_'
                 || CAST(l_linenumber AS VARCHAR) || '.dat' AS short_filename,
             '/data/' || CAST(l_suppkey AS VARCHAR) || '/incoming' AS path
      FROM lineitem)""")

_fx("fx_steps", """
SELECT c_custkey AS task_id, c_name AS task,
       'SRC.T' || CAST(c_custkey % 9 AS VARCHAR) AS source_table,
       'S.Brand#' || CAST(1 + c_custkey % 25 AS VARCHAR) AS target_table_name,
       CASE c_custkey % 4 WHEN 0 THEN 'STD_PARTSWAP' WHEN 1 THEN 'STD_GROUP_TASK' ELSE 'STD_LOAD' END AS template_name
FROM customer""")

_fx("fx_metadata", """
SELECT DISTINCT 'S' AS schema_name, p_brand AS table_name,
       CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0 THEN 'Batch' ELSE 'Date' END AS partitioning_key,
       CAST(substr(p_brand, 7) AS INTEGER) AS retention_value,
       'TS_' || p_brand AS tablespace_variable
FROM part""")

_fx("fx_control", """
SELECT n_name AS object_name,
       CAST(strftime(DATE '2024-01-01' + CAST(i - 1 AS INTEGER), '%Y%m%d') AS INTEGER) AS date_key,
       CASE n_nationkey % 3 WHEN 0 THEN 'LOADED' WHEN 1 THEN 'LOADING' ELSE 'FAILED' END AS processing_status
FROM nation, range(1, 31) AS t(i)
WHERE isodow(DATE '2024-01-01' + CAST(i - 1 AS INTEGER)) - 1 <> n_regionkey""")

_fx("fx_ctl", """
SELECT event_type AS source_system_cd, event_id AS batch_id, ts AS start_time,
       CASE WHEN k % 10 = 0 THEN 'S2S_F' WHEN k % 10 = 1 THEN 'S2S_P' ELSE 'S2S_C' END AS process_status,
       ts - INTERVAL 1 DAY AS min_date_ts, ts AS max_date_ts
FROM fx_ev""", ("fx_ev",))

_fx("fx_job_ctl", """
SELECT event_type || '_' || CAST(event_id % 3 AS VARCHAR) AS record_set,
       date_trunc('day', ts) AS min_date_ts,
       date_trunc('day', ts) + INTERVAL 1 DAY AS max_date_ts
FROM events""")

_fx("fx_rated", """
SELECT event_id AS batch_id, event_type AS source_system_cd FROM events WHERE event_type = 'purchase'""")

_fx("fx_processed_files", """
SELECT 'SRC' || CAST(task_id % 4 AS VARCHAR) AS source_system_cd, short_filename AS filename,
       row_count AS record_count, register_datetime AS processed_date
FROM fx_files""", ("fx_files",))

_fx("fx_jobs", """
SELECT 'DW' AS owner, 'JOB#' || CAST(o_custkey AS VARCHAR) || '#' || CAST(o_orderkey AS VARCHAR) AS job_name,
       CASE o_orderstatus WHEN 'F' THEN 'DISABLED' WHEN 'O' THEN 'RUNNING' ELSE 'SCHEDULED' END AS state,
       o_orderdate AS last_start_date
FROM orders""")

_fx("fx_running_jobs", """
SELECT 'DW' AS owner, 'JOB#' || CAST(o_custkey AS VARCHAR) || '#' || CAST(o_orderkey AS VARCHAR) AS job_name,
       o_orderkey % 150 AS session_id
FROM orders WHERE o_orderstatus = 'O'""")

_fx("fx_scheduled_jobs", """
SELECT 'JOB#' || CAST(o_custkey AS VARCHAR) || '#' || CAST(o_orderkey AS VARCHAR) AS job_name,
       CASE o_orderstatus WHEN 'F' THEN 'DISABLED' WHEN 'O' THEN 'RUNNING' ELSE 'SCHEDULED' END AS job_status
FROM orders""")

_fx("fx_job_log", """
SELECT o_orderkey AS log_id, o_orderdate AS log_date, 'DW' AS owner,
       'JOB#' || CAST(o_custkey AS VARCHAR) || '#' || CAST(o_orderkey AS VARCHAR) AS job_name,
       CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status
FROM orders""")

_fx("fx_job_details", """
SELECT o_orderkey AS log_id,
       'ORA-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 5, '0') || ': job for customer '
         || CAST(o_custkey AS VARCHAR) || ' priority ' || o_orderpriority
         || ' stopped; see the scheduler log for the full stack of the failing statement and its binds' AS additional_info
FROM orders""")

_fx("fx_segments", """
SELECT 'DW' AS owner, p_brand AS segment_name,
       'P_' || strftime(DATE '1995-01-01' + CAST(p_partkey % 2400 AS INTEGER), '%Y%m%d')
            || '_S' || CAST(p_partkey % 4 AS VARCHAR) AS partition_name,
       'P_' || strftime(DATE '1995-01-01' + CAST(p_partkey % 2400 AS INTEGER), '%Y%m%d')
            || '_S' || CAST(p_partkey % 4 AS VARCHAR) AS subpartition_name,
       'TABLE SUBPARTITION' AS segment_type, p_type AS tablespace_name,
       CAST(p_size AS BIGINT) * 1073741824 AS bytes
FROM part""")

_fx("fx_partitions", """
SELECT 'DW' AS owner, p_brand AS table_name,
       CASE WHEN p_partkey % 23 = 0
            THEN 'P_' || strftime(DATE '2016-01-01' + CAST(p_partkey % 365 AS INTEGER), '%Y%m') || '00'
            ELSE 'P_' || strftime(DATE '2016-01-01' + CAST(p_partkey % 365 AS INTEGER), '%Y%m%d') END AS partition_name,
       'P_' || strftime(DATE '2016-01-01' + CAST(p_partkey % 365 AS INTEGER), '%Y%m%d')
            || '_S' || CAST(p_partkey % 4 AS VARCHAR) AS subpartition_name,
       'TS_' || strftime(DATE '2016-01-01' + CAST(p_partkey % 365 - CASE WHEN p_partkey % 17 = 0 THEN 40 ELSE 0 END AS INTEGER), '%Y%m') AS tablespace_name,
       'USABLE' AS status,
       p_partkey AS object_id
FROM part""")

_fx("fx_batch_parts", """
SELECT 'STG_GEN' AS table_owner, 'Brand#' || CAST(1 + o_orderkey % 25 AS VARCHAR) AS table_name,
       'P_' || CAST(o_orderkey AS VARCHAR) AS partition_name,
       CASE WHEN o_orderkey % 9 = 0 THEN 'TS_OTHER' ELSE 'TS_STG_GEN' END AS tablespace_name
FROM orders""")

_fx("fx_ind_parts", """
SELECT 'DW' AS index_owner, 'UK_' || p_brand AS index_name,
       'P_' || strftime(DATE '2016-01-01' + CAST(p_partkey % 365 AS INTEGER), '%Y%m%d') AS partition_name,
       'P_' || strftime(DATE '2016-01-01' + CAST(p_partkey % 365 AS INTEGER), '%Y%m%d')
            || '_S' || CAST(p_partkey % 4 AS VARCHAR) AS subpartition_name,
       CASE WHEN p_size % 10 = 0 THEN 'UNUSABLE' ELSE 'USABLE' END AS part_status,
       CASE WHEN p_size % 7 = 0 THEN 'UNUSABLE' ELSE 'USABLE' END AS subpart_status,
       'TS_' || strftime(DATE '2016-01-01' + CAST(p_partkey % 365 AS INTEGER), '%Y%m') AS tablespace_name
FROM part""")

_fx("fx_indexes", """
SELECT DISTINCT 'DW' AS owner, 'UK_' || p_brand AS index_name, p_brand AS table_name,
       CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 5 = 0 THEN 'UNUSABLE' ELSE 'VALID' END AS status
FROM part""")

_fx("fx_types", """
SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS BIGINT) AS type_no
FROM (SELECT DISTINCT p_type FROM part)""")

_fx("fx_free", """
SELECT t.p_type AS tablespace_name, s.s_suppkey AS file_id,
       CAST(floor(abs(s.s_acctbal)) AS BIGINT) * 1048576 AS bytes
FROM supplier s JOIN fx_types t ON s.s_suppkey % 6 = t.type_no""", ("fx_types",))

_fx("fx_datafiles", """
SELECT p_type AS tablespace_name, p_partkey AS file_id,
       '/u01/' || lower(p_type) || '_' || CAST(p_partkey AS VARCHAR) || '.dbf' AS file_name,
       CAST(p_size AS BIGINT) * 1073741824 AS bytes,
       CASE WHEN p_size % 2 = 0 THEN 'YES' ELSE 'NO' END AS autoextensible,
       CAST(p_size AS BIGINT) * 2147483648 AS maxbytes
FROM part""")

_fx("fx_spaces", """
SELECT DISTINCT p_type AS tablespace_name,
       CASE WHEN p_type = 'LARGE' THEN 'YES' ELSE 'NO' END AS bigfile,
       'ONLINE' AS status
FROM part""")

_fx("fx_temp", """
SELECT 'TEMP' || CAST(s_nationkey % 3 AS VARCHAR) AS tablespace_name,
       CAST(sum(floor(abs(s_acctbal))) AS BIGINT) * 4194304 AS tablespace_size,
       CAST(sum(floor(abs(s_acctbal))) AS BIGINT) * 2097152 AS allocated_space,
       CAST(sum(floor(abs(s_acctbal))) AS BIGINT) * 1048576 AS free_space
FROM supplier GROUP BY 1""")

_fx("fx_disk_groups", """
SELECT CAST(s_nationkey AS VARCHAR) AS name,
       CAST(sum(ceil(abs(s_acctbal))) AS BIGINT) * 2 AS total_mb,
       CAST(sum(floor(abs(s_acctbal))) AS BIGINT) AS free_mb,
       CAST(sum(floor(abs(s_acctbal))) AS BIGINT) // 2 AS usable_file_mb
FROM supplier GROUP BY s_nationkey""")

_fx("fx_queue", """
SELECT 'MAINT' AS queue_name, o_orderpriority AS op,
       'Brand#' || CAST(1 + o_orderkey % 25 AS VARCHAR) AS segment_name,
       'P_' || strftime(o_orderdate, '%Y%m%d') AS partition_name,
       'P_' || strftime(o_orderdate, '%Y%m%d') || '_S' || CAST(o_orderkey % 4 AS VARCHAR) AS subpartition_name,
       CASE WHEN o_orderkey % 3 = 0 THEN 'done'
            WHEN o_orderstatus = 'F' THEN 'FAIL'
            WHEN o_orderstatus = 'O' THEN 'BUSY'
            ELSE 'ready' END AS status,
       CAST(floor(o_totalprice) AS DOUBLE) AS sizmb,
       CAST(o_orderkey AS DOUBLE) AS gboffset,
       o_orderdate AS start_date,
       CAST(1 + (o_custkey % 150) % 2 AS BIGINT) AS inst_id,
       o_custkey % 150 AS sid
FROM orders""")

_fx("fx_sessions", """
SELECT CAST(1 + user_id % 2 AS BIGINT) AS inst_id, event_id AS sid, user_id AS serial,
       'U' || CAST(user_id AS VARCHAR) AS username,
       'MOD_' || event_type AS module,
       'ACT_' || CAST(k % 5 AS VARCHAR) AS action,
       'DW_RUN_ID=' || CASE WHEN value >= 20 THEN CAST(event_id AS VARCHAR) || ' X' ELSE 'NONE' END AS client_info,
       CASE WHEN event_type = 'error' THEN 'enq: TX - row lock contention' ELSE 'db file sequential read' END AS event,
       CASE WHEN event_type IN ('click', 'signup') THEN 'ACTIVE' ELSE 'INACTIVE' END AS status,
       CAST(k % 50 AS VARCHAR) AS sql_id,
       ts AS logon_time, ts AS sql_exec_start,
       k AS seconds_in_wait,
       CASE WHEN event_type = 'error' THEN event_id - 1 END AS blocking_session
FROM fx_ev""", ("fx_ev",))

_fx("fx_locks", """
SELECT event_id AS sid, event_id // 16 AS id1, CAST(dayofmonth(ts) AS BIGINT) AS id2,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS block,
       CASE WHEN event_type = 'click' THEN 6 ELSE 0 END AS request,
       CASE WHEN event_type = 'error' THEN 6 ELSE 0 END AS lmode,
       'TX' AS type
FROM fx_ev WHERE event_type IN ('error', 'click')""", ("fx_ev",))

_fx("fx_locked_objects", """
SELECT k AS object_id, event_id AS session_id,
       CASE WHEN event_type = 'error' THEN 6 ELSE 3 END AS locked_mode,
       'U' || CAST(user_id AS VARCHAR) AS oracle_username
FROM fx_ev WHERE event_type IN ('error', 'click')""", ("fx_ev",))

_fx("fx_objects", """
SELECT p_partkey AS object_id, 'DW' AS owner, 'T_' || CAST(p_partkey AS VARCHAR) AS object_name,
       'TABLE' AS object_type
FROM part""")

_fx("fx_ddl_locks", f"""
SELECT event_id AS session_id, 'DW' AS owner, {TASK_NAME.format(c='user_id')} AS name,
       'Table/Procedure/Type' AS type,
       CASE WHEN event_type = 'signup' THEN 'Exclusive' ELSE 'Share' END AS mode_held
FROM events WHERE event_type IN ('signup', 'purchase')""")

_fx("fx_longops", """
SELECT CAST(1 + user_id % 2 AS BIGINT) AS inst_id, event_id AS sid, user_id AS serial,
       CASE event_type WHEN 'view' THEN 'Sort Output' WHEN 'click' THEN 'Hash Join'
            WHEN 'signup' THEN 'Table Scan' WHEN 'purchase' THEN 'Insert'
            ELSE 'Index Fast Full Scan' END AS opname,
       CASE event_type WHEN 'view' THEN 'Sort Output' WHEN 'click' THEN 'Hash Join'
            WHEN 'signup' THEN 'Table Scan' WHEN 'purchase' THEN 'Insert'
            ELSE 'Index Fast Full Scan' END || ': T_' || CAST(k AS VARCHAR) AS message,
       'T_' || CAST(k AS VARCHAR) AS target,
       CASE WHEN event_type IN ('view', 'purchase') THEN 'Rows' ELSE 'Blocks' END AS units,
       CAST(floor(value) AS BIGINT) AS sofar,
       CAST(floor(value) AS BIGINT) + k AS totalwork,
       k AS elapsed_seconds, k % 7 AS time_remaining,
       CAST(k % 50 AS VARCHAR) AS sql_id,
       ts AS start_time
FROM fx_ev""", ("fx_ev",))

_fx("fx_sql", """
SELECT CAST(1 + l_suppkey % 2 AS BIGINT) AS inst_id, CAST(l_partkey AS VARCHAR) AS sql_id,
       'SELECT /* part ' || CAST(l_partkey AS VARCHAR) || ' */ * FROM FCT_' || CAST(l_partkey % 100 AS VARCHAR) AS sql_text,
       CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS cpu_time,
       CAST(floor(l_extendedprice) AS BIGINT) * 2000 AS elapsed_time,
       l_suppkey AS disk_reads,
       CAST(floor(l_extendedprice) AS BIGINT) AS buffer_gets,
       CAST(l_linenumber AS BIGINT) AS executions,
       CAST(floor(l_quantity) AS BIGINT) % 10 AS rows_processed
FROM lineitem""")

_fx("fx_sqltext", """
SELECT CAST(1 + l_suppkey % 2 AS BIGINT) AS inst_id, CAST(l_partkey AS VARCHAR) AS sql_id, CAST(l_linenumber - 1 AS BIGINT) AS piece,
       'piece ' || CAST(l_linenumber AS VARCHAR) || ' of ' || CAST(l_orderkey AS VARCHAR) AS sql_text
FROM lineitem""")

_fx("fx_stats", """
SELECT CAST(1 + l_suppkey % 2 AS BIGINT) AS inst_id, l_suppkey AS sid,
       CAST(l_linenumber AS BIGINT) AS statistic, l_quantity AS value
FROM lineitem""")

_fx("fx_stat_names", """
SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS statistic, 'stat_' || CAST(l_linenumber AS VARCHAR) AS name
FROM lineitem""")

_fx("fx_listing", """
SELECT short_filename AS name, max(register_datetime) AS modification_time, CAST(sum(row_count) AS BIGINT) AS length
FROM fx_files GROUP BY short_filename""", ("fx_files",))

_fx("fx_manifest", """
SELECT short_filename AS name FROM fx_files
UNION
SELECT 'F' || CAST(s_suppkey AS VARCHAR) || '_HEADER.dat' AS name FROM supplier""", ("fx_files",))

_fx("fx_audit", f"""
SELECT 'U' || CAST(user_id AS VARCHAR) AS username, {TASK_NAME.format(c='user_id')} AS obj_name,
       CASE event_type WHEN 'error' THEN 'DROP' WHEN 'signup' THEN 'CREATE' ELSE 'ALTER' END AS action_name,
       ts AS event_time
FROM events""")

_fx("fx_staging", """
SELECT l_orderkey AS batch_id, l_returnflag AS record_type,
       CASE WHEN l_linenumber = 4 THEN NULL ELSE l_linestatus END AS code,
       l_partkey AS item_key
FROM lineitem""")

_fx("fx_errors", """
SELECT 'ERR_RUNS' AS table_name, message AS err_message, error_sysdate AS insert_date
FROM fx_log WHERE error_code = 'E'
UNION ALL
SELECT 'ERR_FILES' AS table_name, 'BAD ROWS IN ' || processing_status AS err_message, register_datetime AS insert_date
FROM fx_files""", ("fx_log", "fx_files"))

_fx("fx_dim_period", """
SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS fin_year, CAST(month(o_orderdate) AS INTEGER) AS period_no,
       'C' || CAST(o_custkey % 3 AS VARCHAR) AS company_code
FROM orders""")


_NAME = re.compile(r"\bfx_[a-z_]+\b")


def _closure(names: set[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in DEPS[n]:
            visit(d)
        order.append(n)

    for n in sorted(names):
        visit(n)
    return order


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fx_* CTEs it references (dependencies first)."""
    used = {n for n in _NAME.findall(sql) if n in FX}
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({FX[n].strip()})" for n in _closure(used))
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
