"""The maintenance report as a master/detail tree.

The report shows a queue summary (C14); selecting a row binds its segment
name, and ten detail displays run for that segment.  Here the tree is one
function returning named DataFrames: nothing runs until a caller acts on one,
and each detail is its own Spark job over the shared snapshots.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from opsight.operators.capacity import queue_detail, queue_space, queue_summary, segment_space
from opsight.operators.sessions import (
    log_of_busy_items, session_stat_totals, sibling_sessions, statement_ratios,
)
from opsight.operators.throughput import longops_rollup


def maintenance_report(queue: DataFrame, segments: DataFrame, sessions: DataFrame, log: DataFrame,
                       tasks: DataFrame, longops: DataFrame, sql: DataFrame, stats: DataFrame,
                       stat_names: DataFrame, segment: str, as_of: dt.datetime,
                       log_session_key: str = "id_2", log_days: float = 0.1) -> dict[str, DataFrame]:
    """Master (queue summary) and the details of one selected ``segment``."""
    return {
        "queue_summary": queue_summary(queue),                                   # master
        "segment_space": segment_space(segments, queue, segment),                # C16
        "queue_detail": queue_detail(queue, segment, as_of),                     # C15
        "queue_space": queue_space(segments, queue),                             # C17
        "log_of_busy_items": log_of_busy_items(log, tasks, queue, segment, as_of, log_days,
                                               session_key=log_session_key),     # G2
        "sibling_sessions": sibling_sessions(sessions, queue, segment, as_of),   # G11
        "longops_rollup": longops_rollup(longops, sessions, queue, segment),     # T8
        "statement_ratios": statement_ratios(sql, sessions, queue, segment),     # G12
        "session_stat_totals": session_stat_totals(stats, stat_names, sessions, queue, segment),  # G13
    }
