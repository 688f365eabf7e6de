"""Declared schemas of the load-framework tables the operators read.

The framework's tables are declared in the database, not in the scripts; the
column sets and types here follow FIXTURES.md part A (as realised by the
fx_* adapters).  ``conform`` checks a DataFrame on read: every declared column
must be present, and each is cast to its declared type - no inference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DDL = {
    "tasks": (
        "task_id bigint, task string, max_key int, is_runnable string, task_type string, parameter_type "
        "string, task_business_area string, task_technical_area string, task_target_type string, "
        "source_system string, pattern_task string, copy_batch_ind string, super_batch_ind string, "
        "max_file_load_concurrency bigint, flex1 string, flex2 string"
    ),
    "runs": (
        "run_id bigint, task_id bigint, batch_id bigint, task string, run_status string, start_date "
        "timestamp_ntz, end_date timestamp_ntz, rows_loaded bigint, rows_error bigint, rows_inserted "
        "bigint, rows_updated bigint, diy_parameter string, direct_exec_sql string, remark string"
    ),
    "ranges": (
        "run_id bigint, task string, run_status string, start_date timestamp_ntz, end_date timestamp_ntz, "
        "rows_loaded bigint"
    ),
    "log": (
        "log_id bigint, task_id bigint, run_id bigint, batch_id bigint, process_name string, message "
        "string, error_code string, error_sysdate timestamp_ntz, id_1 string, id_2 string, id_3 string, "
        "id_4 string, sid bigint, inst_id bigint"
    ),
    "batches": (
        "batch_id bigint, task_id bigint, table_name string, dw_date_key int, dw_max_date_key int, "
        "load_status string, record_count bigint, super_batch_ind string, super_batch_id bigint, "
        "copied_batch_id bigint, create_datetime timestamp_ntz, audit_start_date timestamp_ntz, "
        "load_start_date timestamp_ntz"
    ),
    "files": (
        "file_key bigint, task_id bigint, batch_id bigint, filename string, short_filename string, path "
        "string, processing_status string, row_count bigint, base_row_count bigint, bad_row_count bigint, "
        "log_errors_row_count bigint, max_dw_date_key int, register_datetime timestamp_ntz, "
        "start_datetime timestamp_ntz, md5_checksum string, line_no int"
    ),
    "steps": "task_id bigint, task string, source_table string, target_table_name string, template_name string",
    "metadata": (
        "schema_name string, table_name string, partitioning_key string, retention_value int, "
        "tablespace_variable string"
    ),
    "control": "object_name string, date_key int, processing_status string",
    "ctl": (
        "source_system_cd string, batch_id bigint, start_time timestamp_ntz, process_status string, "
        "min_date_ts timestamp_ntz, max_date_ts timestamp_ntz"
    ),
    "job_ctl": "record_set string, min_date_ts timestamp_ntz, max_date_ts timestamp_ntz",
    "rated": "batch_id bigint, source_system_cd string",
    "processed_files": "source_system_cd string, filename string, record_count bigint, processed_date timestamp_ntz",
    "jobs": "owner string, job_name string, state string, last_start_date timestamp_ntz",
    "running_jobs": "owner string, job_name string, session_id bigint",
    "scheduled_jobs": "job_name string, job_status string",
    "job_log": "log_id bigint, log_date timestamp_ntz, owner string, job_name string, status string",
    "job_details": "log_id bigint, additional_info string",
    "segments": (
        "owner string, segment_name string, partition_name string, subpartition_name string, segment_type "
        "string, tablespace_name string, bytes bigint"
    ),
    "partitions": (
        "owner string, table_name string, partition_name string, subpartition_name string, "
        "tablespace_name string, status string, object_id bigint"
    ),
    "ind_parts": (
        "index_owner string, index_name string, partition_name string, subpartition_name string, "
        "part_status string, subpart_status string, tablespace_name string"
    ),
    "indexes": "owner string, index_name string, table_name string, status string",
    "free": "tablespace_name string, file_id bigint, bytes bigint",
    "datafiles": (
        "tablespace_name string, file_id bigint, file_name string, bytes bigint, autoextensible string, "
        "maxbytes bigint"
    ),
    "spaces": "tablespace_name string, bigfile string, status string",
    "temp": "tablespace_name string, tablespace_size bigint, allocated_space bigint, free_space bigint",
    "disk_groups": "name string, total_mb bigint, free_mb bigint, usable_file_mb bigint",
    "queue": (
        "queue_name string, op string, segment_name string, partition_name string, subpartition_name "
        "string, status string, sizmb double, gboffset double, start_date timestamp_ntz, inst_id bigint, "
        "sid bigint"
    ),
    "sessions": (
        "inst_id bigint, sid bigint, serial bigint, username string, module string, action string, "
        "client_info string, event string, status string, sql_id string, logon_time timestamp_ntz, "
        "sql_exec_start timestamp_ntz, seconds_in_wait bigint, blocking_session bigint"
    ),
    "locks": "sid bigint, id1 bigint, id2 bigint, block int, request int, lmode int, type string",
    "locked_objects": "object_id bigint, session_id bigint, locked_mode int, oracle_username string",
    "objects": "object_id bigint, owner string, object_name string, object_type string",
    "ddl_locks": "session_id bigint, owner string, name string, type string, mode_held string",
    "longops": (
        "inst_id bigint, sid bigint, serial bigint, opname string, message string, target string, units string, "
        "sofar bigint, totalwork bigint, elapsed_seconds bigint, time_remaining bigint, sql_id string, "
        "start_time timestamp_ntz"
    ),
    "sql": (
        "inst_id bigint, sql_id string, sql_text string, cpu_time bigint, elapsed_time bigint, disk_reads "
        "bigint, buffer_gets bigint, executions bigint, rows_processed bigint"
    ),
    "sqltext": "inst_id bigint, sql_id string, piece bigint, sql_text string",
    "stats": "inst_id bigint, sid bigint, statistic bigint, value double",
    "stat_names": "statistic bigint, name string",
    "listing": "name string, modification_time timestamp_ntz, length bigint",
    "manifest": "name string",
    "audit": "username string, obj_name string, action_name string, event_time timestamp_ntz",
    "staging": "batch_id bigint, record_type string, code string, item_key bigint",
    "errors": "table_name string, err_message string, insert_date timestamp_ntz",
    "dim_period": "fin_year int, period_no int, company_code string",
    "batch_parts": "table_owner string, table_name string, partition_name string, tablespace_name string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def conform(df: DataFrame, name: str, extra: bool = True) -> DataFrame:
    """Select the declared columns of table ``name`` with their declared types.

    Missing columns raise; ``extra=True`` keeps undeclared columns after them.
    """
    declared = schema(name)
    missing = [f.name for f in declared.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in declared.fields]
    rest = [c for c in df.columns if c not in {f.name for f in declared.fields}] if extra else []
    return df.select(*cols, *rest)
