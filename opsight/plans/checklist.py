"""The daily support checklist: numbered checks -> operators.

Support staff run the checks in order and paste each result into the sheet
of the same number; "empty" checks must return no rows when all is well.
``run_checklist`` builds every check lazily and, with ``out_dir``, writes
each result as a CSV sheet (one Spark job per check, run in parallel by the
cluster; nothing is collected to the driver).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from opsight.plans.registry import registry

# The checklist's check numbers, what each asks, the operator
# queries that answer it, and whether a healthy system returns no rows.
CHECKLIST = (
    (1, "process dates", ("process_date_lag",), False),
    (2, "failed runs", ("failed_run_detail", "failed_run_alerts"), True),
    (3, "run queues per task", ("queue_backlog",), True),
    (4, "long running runs", ("long_running",), True),
    (5, "disabled and running scheduler jobs", ("job_state_report",), False),
    (6, "failed and stuck audits", ("audit_backlog",), True),
    (7, "waiting snapshot runs", ("wait_time_topn",), False),
    (8, "targets behind the process date", ("stale_targets",), False),
    (9, "tasks that have not run for days", ("dormant_tasks",), False),
    (10, "integration loaded for the process date", ("load_presence",), False),
    (11, "scheduled jobs not being run", ("scheduled_not_running",), True),
    (12, "scheduler jobs failing today", ("job_failures_on_day",), True),
    (13, "bad rows of file loaders", ("bad_row_rate",), False),
    (14, "batches waiting to be super-batched", ("unmerged_batches",), True),
    (15, "snapshot run profile", ("recent_run_profile",), False),
    (16, "file loaders up to date", ("loader_freshness",), False),
    (18, "error tables in trend", ("error_trend",), False),
    (19, "audited batches that are empty", ("empty_batches",), True),
    (20, "partition-swap provisioning", ("provision_shortfall",), True),
    (21, "files not archived", ("unarchived_files",), False),
    (22, "unusable or invalid indexes", ("invalid_objects",), True),
    (23, "tablespaces needing a datafile", ("capacity_alert",), True),
    (24, "disk space and workflow status", ("disk_usage", "workflow_status"), False),
    (26, "job control parameters", ("parameter_check",), False),
    (27, "files registered per day", ("calendar_file_counts",), False),
)


def checklist(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every check as ``"<n>_<query>" -> DataFrame`` (lazy)."""
    reg = registry()
    return {f"{n:02d}_{q}": reg[q].build(spark, sf_dir) for n, _, queries, _ in CHECKLIST for q in queries}


def run_checklist(spark: SparkSession, sf_dir: str, out_dir: str) -> list[str]:
    """Write every check as a CSV sheet under ``out_dir``; returns the sheet paths."""
    from opsight.sources.readers import to_sheet
    paths = []
    for key, df in checklist(spark, sf_dir).items():
        path = os.path.join(out_dir, f"sheet_{key}")
        to_sheet(df, path)
        paths.append(path)
    return paths
