"""Bridge from the load framework's own tables to the operators' inputs.

A site that runs the monitoring scripts today has tables such as ``DW_TASKS``
and ``DW_RT_RUNS`` with ``DW_``-prefixed key columns.  ``framework_tables``
reads them through any reader (catalog table, JDBC link, parquet export),
renames the columns to the operator schema and checks them with
``schemas.conform`` - so every check runs on the site's tables unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.sources.schemas import conform

# The framework's table names for each operator input.
FRAMEWORK_TABLES = {
    "tasks": "DW_TASKS",
    "runs": "DW_RT_RUNS",
    "batches": "DW_RT_BATCHES",
    "files": "DW_RT_FILES",
    "ranges": "DW_RT_RANGE_RUNS",
    "log": "DW_RT_LOG_APP",
    "steps": "DW_TASK_EXEC_STEPS",
    "metadata": "DW_TABLE_METADATA",
}

# Framework column names that differ from the operator schema
# (all other columns are the same name in lower case).
FRAMEWORK_COLUMNS = {
    "DW_TASK_ID": "task_id",
    "DW_RUN_ID": "run_id",
    "DW_BATCH_ID": "batch_id",
    "DW_COPIED_BATCH_ID": "copied_batch_id",
    "DW_SUPER_BATCH_ID": "super_batch_id",
    "DW_FILE_KEY": "file_key",
    "DW_LOG_ID": "log_id",
    "DW_SID": "sid",
    "DW_INST_ID": "inst_id",
}


def to_operator_columns(df: DataFrame) -> DataFrame:
    """Rename framework columns (``DW_TASK_ID`` ...) to the operator schema names."""
    return df.select(*[F.col(f"`{c}`").alias(FRAMEWORK_COLUMNS.get(c.upper(), c.lower())) for c in df.columns])


def framework_tables(read: Callable[[str], DataFrame], names=None, schema_prefix: str = "") -> dict[str, DataFrame]:
    """Operator inputs read from the framework's tables.

    ``read`` maps a table name (e.g. ``"META.DW_RT_RUNS"`` with a schema
    prefix) to a DataFrame: ``spark.table``, or a JDBC reader such as
    ``lambda t: readers.remote_table(spark, url, t, props, "DW_RUN_ID", lo, hi, 64)``.
    """
    out = {}
    for name in names or FRAMEWORK_TABLES:
        df = to_operator_columns(read(schema_prefix + FRAMEWORK_TABLES[name]))
        out[name] = conform(df, name)
    return out
