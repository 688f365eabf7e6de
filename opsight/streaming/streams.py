"""Structured Streaming counterparts of the polling checks.

The scripts re-run "the last x hours" queries; here the same questions are
continuous.  Each builder takes a DataFrame that may be streaming or batch: on
a stream it adds the watermark that bounds state, on a batch it computes the
final result of every window.

The registered queries run as streams: ``replay`` writes the table as files, in
deliveries; after each delivery a query is started from the checkpoint that the
one before left, and reads what is new (``readStream``,
``trigger(availableNow=True)``).  The last delivery carries a closing row far
in the future, so that the watermark passes every window of the table.

State grows with open windows only: a watermark on every input ends it.  A hot
key does not gather its rows in one task: hourly counts are summed before the
shuffle, sessions are merged inside each partition before it (the stream
session sets the option for that), and the batch form groups by gap-wide slots
first, so one row a slot is what meets.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsight.functions.expr import ts_lit
from opsight.plans.registry import query
from opsight.session import checkpoint_dir
from opsight.sources.fixtures import fixtures
from opsight.sources.readers import forget

#: Settings of the session that runs the streams; the caller's session keeps its own.
STREAM_CONF = {
    "spark.sql.session.timeZone": "UTC",           # zone-free clocks read as zoned ones, and back, unchanged
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # State larger than an executor's heap.  Each trigger leaves it compacted: looking a key up steps over every
    # key deleted next to it, and a changelog would bring those back at the next start.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "true",
}

_FAR = "INTERVAL 400 DAYS"


def event_time(df: DataFrame, column: str, alias: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): add a zoned copy of the clock column.

    A batch DataFrame keeps the zone-free value (windows then do not depend on
    the session time zone); only a stream needs the zoned copy.
    """
    return df.withColumn(alias, F.col(column).cast("timestamp") if df.isStreaming else F.col(column))


def watermarked(df: DataFrame, column: str, lateness: str, alias: str = "event_time") -> DataFrame:
    """Event-time column plus a watermark on streams (a batch has nothing late)."""
    e = event_time(df, column, alias)
    return e.withWatermark(alias, lateness) if df.isStreaming else e


def _ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


# --------------------------------------------------------------------- runner
@dataclass(frozen=True)
class Replay:
    """What a stream wrote, and what its triggers reported."""

    rows: DataFrame
    progress: list[dict]
    plan: str

    @property
    def rows_in(self) -> int:
        """Rows that the triggers read."""
        return sum(p["numInputRows"] for p in self.progress)

    @property
    def dropped(self) -> int:
        """Rows (sums of rows, where a task had several of one window) that came behind the watermark."""
        return sum(s.get("numRowsDroppedByWatermark", 0) for p in self.progress for s in p["stateOperators"])


def _stream_session(spark: SparkSession, partitions: int | None) -> SparkSession:
    own = spark.newSession()
    for key, value in STREAM_CONF.items():
        own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", partitions or spark.sparkContext.defaultParallelism)
    return own


def _available_now(own: SparkSession, source: str, schema, build, sink: str, state: str) -> tuple[DataFrame, list[dict], str]:
    """Start from the checkpoint in ``state``, read all that is new, stop."""
    out = build(own.readStream.schema(schema).parquet(source))
    q = (out.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", state).trigger(availableNow=True).start())
    q.awaitTermination()
    return out, [p if isinstance(p, dict) else json.loads(p.json) for p in q.recentProgress], q._jsq.explainInternal(False)


def run_available_now(spark: SparkSession, source_dir: str, schema, build, name: str, prepare=None,
                      partitions: int | None = None) -> DataFrame:
    """Run ``build`` as a stream over every new file in ``source_dir`` and return all rows of its sink.

    Sink (parquet, exactly once) and checkpoint stand under the session's
    shared checkpoint folder by ``name``: run again, also by another driver,
    the stream resumes where it was and adds what is new.  Executor loss is
    handled by Structured Streaming's replay from the checkpoint.  State has
    ``partitions`` parts (the cluster's cores by default), fixed by the first run.
    """
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    whole = build if prepare is None else lambda src: build(prepare(src))
    out, _, _ = _available_now(_stream_session(spark, partitions), source_dir, schema, whole, f"{base}-rows", base)
    return spark.read.schema(out.schema).parquet(f"{base}-rows")


def replay(spark: SparkSession, name: str, deliveries: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame],
           partitions: int | None = None) -> Replay:
    """Run ``build`` as a stream over ``deliveries``, restarted from its checkpoint after each.

    Each delivery is written as files before its run.  Files and state are
    deleted at the end; the rows stay in the shared checkpoint folder.
    """
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    own = _stream_session(spark, partitions)
    progress: list[dict] = []
    plan = ""
    for delivery in deliveries:
        delivery.write.mode("append").parquet(f"{base}/in")
        out, more, plan = _available_now(own, f"{base}/in", delivery.schema, build, f"{base}/rows", f"{base}/state")
        progress += more
    forget(spark, f"{base}/in")
    forget(spark, f"{base}/state")
    return Replay(spark.read.schema(out.schema).parquet(f"{base}/rows"), progress, plan)


def closing_rows(df: DataFrame, column: str, *values: dict) -> DataFrame:
    """Rows of ``df``'s schema long after its last: a stream that reads them closes all windows before."""
    last = df.agg((F.max(column) + F.expr(_FAR)).alias("last"))
    filled = [{column: F.col("last")} | {c: F.lit(v) for c, v in own.items()} for own in (values or ({},))]
    rows = F.explode(F.array(*[F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]) for own in filled]))
    return last.select(rows.alias("r")).select("r.*")


# --------------------------------------------------------------------- islands
def _micros(c: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(c))


def islands(df: DataFrame, keys: Sequence[str], column: str, gap: dt.timedelta, partial: dict[str, Column],
            merge: dict[str, Callable[[str], Column]]) -> DataFrame:
    """One row for each stretch of a key's rows in which none is more than ``gap`` after the one before.

    Rows of a slot as wide as the gap always belong together, so they are
    aggregated first, before the shuffle: a key with a third of all rows comes
    down to one row a slot and task.  Slots of a key then meet in time order,
    as many as the span of time has.  ``first`` and ``last`` are the stretch's
    clocks; ``partial`` aggregates rows, ``merge`` the same columns of slots.
    """
    width = gap // dt.timedelta(microseconds=1)
    slots = (df.filter(F.col(column).isNotNull()).withColumn("__slot", F.floor(_micros(column) / F.lit(width)))
             .groupBy(*keys, "__slot").agg(F.min(column).alias("first"), F.max(column).alias("last"), *[c.alias(n) for n, c in partial.items()]))
    by = Window.partitionBy(*keys).orderBy("__slot")
    near = F.timestamp_diff("MICROSECOND", F.lag("last").over(by), F.col("first")) <= width
    return (slots.withColumn("__new", F.when(near, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(by))
            .groupBy(*keys, "__island").agg(F.min("first").alias("first"), F.max("last").alias("last"), *[f(n).alias(n) for n, f in merge.items()])
            .drop("__island"))


def _interval(gap: dt.timedelta) -> str:
    return f"{gap // dt.timedelta(microseconds=1)} microseconds"


# --------------------------------------------------------------------- ST1
def stream_hourly(df: DataFrame, ts_col: str, value_col: str | None = None, lateness: str = "2 hours",
                  window: str = "1 hour", slide: str | None = None, keys=()) -> DataFrame:
    """Rows (and a value sum) per tumbling - or sliding - event-time window."""
    e = watermarked(df, ts_col, lateness)
    w = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    aggs = [F.count(F.lit(1)).alias("cnt")]
    if value_col:
        aggs.append(F.sum(value_col).cast("long").alias("total"))
    g = e.groupBy(w.alias("w"), *keys).agg(*aggs)
    return g.select(_ntz("w.start").alias("window_start"), _ntz("w.end").alias("window_end"), *keys,
                    *[a for a in ["cnt", "total"] if a in g.columns])


def file_deliveries(files: DataFrame, cut: dt.datetime) -> list[DataFrame]:
    """Registrations as they come in: those after ``cut`` second, and with them the earlier ones whose archiving failed."""
    first = (F.col("register_datetime") < ts_lit(cut)) & (F.col("processing_status") != "ARCHFAILED")
    return [files.filter(first), files.filter(~first).unionByName(closing_rows(files, "register_datetime"))]


_CUT = dt.datetime(1998, 6, 1)
_HOURLY_COLUMNS = ("file_key", "processing_status", "register_datetime", "row_count")

#: Rows that the stream counts: all of the first delivery, and of the second those whose window was open.
_ON_TIME = """
told AS (SELECT *, register_datetime < TIMESTAMP '1998-06-01' AND processing_status <> 'ARCHFAILED' AS early FROM fx_files),
mark AS (SELECT max(register_datetime) - INTERVAL 2 HOUR AS passed FROM told WHERE early)"""


def _hourly_replay(spark, sf, **how) -> Replay:
    files = fixtures(spark, sf).files.select(*_HOURLY_COLUMNS)
    return replay(spark, "hourly", file_deliveries(files, _CUT), lambda d: stream_hourly(d, "register_datetime", "row_count", **how))


@query("stream_hourly", "ST1", f"""
WITH {_ON_TIME}
SELECT date_trunc('hour', register_datetime) AS window_start,
       date_trunc('hour', register_datetime) + INTERVAL 1 HOUR AS window_end,
       count(*) AS cnt, CAST(sum(row_count) AS BIGINT) AS total
FROM told, mark WHERE early OR date_trunc('hour', register_datetime) + INTERVAL 1 HOUR > passed GROUP BY 1, 2
""")
def q_stream_hourly(spark, sf):
    return _hourly_replay(spark, sf).rows


@query("stream_hourly_sliding", "ST1", f"""
WITH {_ON_TIME},
windows AS (
  SELECT told.*, passed, date_trunc('hour', register_datetime) - to_hours(b) AS window_start
  FROM told, mark, (VALUES (0), (1)) AS back(b))
SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, processing_status,
       count(*) AS cnt, CAST(sum(row_count) AS BIGINT) AS total
FROM windows WHERE early OR window_start + INTERVAL 2 HOUR > passed GROUP BY ALL
""")
def q_stream_hourly_sliding(spark, sf):
    return _hourly_replay(spark, sf, window="2 hours", slide="1 hour", keys=("processing_status",)).rows


def late_rows(run: Replay, closing: int = 1) -> DataFrame:
    """Rows delivered (from the triggers' progress), rows counted in windows, and the late ones between.

    ``dropped`` says that the progress reported rows behind the watermark.
    """
    spark = run.rows.sparkSession
    return run.rows.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("counted")).select(
        F.lit(run.rows_in - closing).cast("long").alias("delivered"), "counted",
        (F.lit(run.rows_in - closing).cast("long") - F.col("counted")).alias("late"), F.lit(run.dropped > 0).alias("dropped"))


@query("stream_late_rows", "ST1", f"""
WITH {_ON_TIME}
SELECT count(*) AS delivered, count(*) FILTER (early OR date_trunc('hour', register_datetime) + INTERVAL 1 HOUR > passed) AS counted,
       count(*) FILTER (NOT early AND date_trunc('hour', register_datetime) + INTERVAL 1 HOUR <= passed) AS late, late > 0 AS dropped
FROM told, mark
""")
def q_stream_late_rows(spark, sf):
    return late_rows(_hourly_replay(spark, sf))


# --------------------------------------------------------------------- ST2
def _milestones() -> dict[str, Column]:
    m = F.col("message")
    return {
        "start_date": F.max(F.when(m.like("%Task: TF_%"), F.col("error_sysdate"))),
        "end_date": F.max(F.when(m.like("END: File Task Register"), F.col("error_sysdate"))),
        "files_moved": F.max(F.when(m.like("%Do_Batch_Move: Move Success Update activity count:%"),
                                    F.trim(F.replace(m, F.lit("Do_Batch_Move: Move Success Update activity count:"), F.lit(""))))),
        "logs_cnt": F.count(F.lit(1))}


def stream_session_pivot(log: DataFrame, gap: dt.timedelta = dt.timedelta(minutes=30), lateness: str = "1 hour",
                         key: str = "task_id") -> DataFrame:
    """Registration sessions by activity gap, with milestone times and counts."""
    if not log.isStreaming:
        merge = {n: F.max for n in ("start_date", "end_date", "files_moved")} | {"logs_cnt": F.sum}
        g = islands(log, [key], "error_sysdate", gap, _milestones(), merge)
        return g.select(key, F.col("first").alias("session_start"), (F.col("last") + F.expr(f"INTERVAL '{gap.total_seconds()}' SECOND")).alias("session_end"),
                        "start_date", "end_date", "files_moved", "logs_cnt")
    e = watermarked(log, "error_sysdate", lateness)
    g = e.groupBy(key, F.session_window("event_time", _interval(gap)).alias("s")).agg(*[c.alias(n) for n, c in _milestones().items()])
    return g.select(key, _ntz("s.start").alias("session_start"), _ntz("s.end").alias("session_end"),
                    "start_date", "end_date", "files_moved", "logs_cnt")


_SESSIONS_SQL = """
WITH x AS (
  SELECT *, CASE WHEN lag(error_sysdate) OVER (PARTITION BY task_id ORDER BY error_sysdate, log_id) IS NULL
                   OR error_sysdate > lag(error_sysdate) OVER (PARTITION BY task_id ORDER BY error_sysdate, log_id)
                                       + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s
  FROM fx_log),
y AS (SELECT *, sum(new_s) OVER (PARTITION BY task_id ORDER BY error_sysdate, log_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s_id FROM x)
SELECT task_id, min(error_sysdate) AS session_start, max(error_sysdate) + INTERVAL 30 MINUTE AS session_end,
       max(CASE WHEN message LIKE '%Task: TF_%' THEN error_sysdate END) AS start_date,
       max(CASE WHEN message LIKE 'END: File Task Register' THEN error_sysdate END) AS end_date,
       max(CASE WHEN message LIKE '%Do_Batch_Move: Move Success Update activity count:%'
                THEN trim(replace(message, 'Do_Batch_Move: Move Success Update activity count:', '')) END) AS files_moved,
       count(*) AS logs_cnt
FROM y GROUP BY task_id, s_id
"""

_MIDDLE = dt.datetime(2024, 1, 16, 12)


def log_deliveries(log: DataFrame, cut: dt.datetime, *closing: dict) -> list[DataFrame]:
    """Log rows up to ``cut``, and the rest with closing rows: what is open at the cut goes on in state."""
    first = F.col("error_sysdate") < ts_lit(cut)
    return [log.filter(first), log.filter(~first).unionByName(closing_rows(log, "error_sysdate", *closing))]


@query("stream_session_pivot", "ST2", _SESSIONS_SQL)
def q_stream_session_pivot(spark, sf):
    log = fixtures(spark, sf).log.select("log_id", "task_id", "message", "error_sysdate")
    return replay(spark, "sessions", log_deliveries(log, _MIDDLE), stream_session_pivot).rows


@query("session_pivot", "ST2", _SESSIONS_SQL)
def q_session_pivot(spark, sf):
    return stream_session_pivot(fixtures(spark, sf).log)


# --------------------------------------------------------------------- ST3
def stream_start_end(log: DataFrame, max_span: str = "1 day", lateness: str = "2 hours",
                     key: str = "id_2") -> DataFrame:
    """Start message joined to the first end message of the same session within ``max_span``.

    Stream-stream left outer join: both sides are watermarked and the time
    range bounds the state; an unmatched start is emitted (with NULL end)
    once the watermark passes ``start + max_span``.  Of several ends the
    earliest (then the smallest id) counts, so there is one row for each start.
    """
    e = event_time(log, "error_sysdate")
    s = e.filter(F.col("message").like("%Task: TF_%")).select(
        F.col(key).alias("s_key"), F.col("event_time").alias("s_time"), F.col("log_id").alias("start_log_id"))
    t = e.filter(F.col("message") == "END: File Task Register").select(
        F.col(key).alias("e_key"), F.col("event_time").alias("e_time"), F.col("log_id").alias("end_log_id"))
    if log.isStreaming:
        s, t = s.withWatermark("s_time", lateness), t.withWatermark("e_time", lateness)
    cond = (F.col("s_key") == F.col("e_key")) & (F.col("e_time") >= F.col("s_time")) \
        & (F.col("e_time") <= F.col("s_time") + F.expr(f"INTERVAL {max_span}"))
    j = s.join(t, cond, "leftOuter").groupBy("s_key", "start_log_id", "s_time").agg(
        F.min(F.when(F.col("e_time").isNotNull(), F.struct("e_time", "end_log_id"))).alias("e"))
    return j.select(F.col("s_key").alias(key), "start_log_id", _ntz("s_time").alias("start_time"),
                    F.col("e.end_log_id").alias("end_log_id"), _ntz("e.e_time").alias("end_time"))


@query("stream_start_end", "ST3", """
WITH starts AS (SELECT id_2, log_id, error_sysdate FROM fx_log WHERE message LIKE '%Task: TF_%'),
     ends AS (SELECT id_2, log_id, error_sysdate FROM fx_log WHERE message = 'END: File Task Register')
SELECT id_2, starts.log_id AS start_log_id, starts.error_sysdate AS start_time,
       first(ends.log_id ORDER BY ends.error_sysdate, ends.log_id) AS end_log_id, min(ends.error_sysdate) AS end_time
FROM starts LEFT JOIN ends USING (id_2)
  WHERE ends.log_id IS NULL OR ends.error_sysdate BETWEEN starts.error_sysdate AND starts.error_sysdate + INTERVAL 1 DAY
GROUP BY ALL
UNION ALL
SELECT id_2, log_id, error_sysdate, NULL, NULL
FROM starts
WHERE EXISTS (FROM ends WHERE ends.id_2 = starts.id_2)
  AND NOT EXISTS (FROM ends WHERE ends.id_2 = starts.id_2
                  AND ends.error_sysdate BETWEEN starts.error_sysdate AND starts.error_sysdate + INTERVAL 1 DAY)
""")
def q_stream_start_end(spark, sf):
    log = fixtures(spark, sf).log.select("log_id", "id_2", "message", "error_sysdate")
    # With a key of their own: a row without one is filtered before it moves the watermark.
    closing = [{"message": m, "id_2": "closing"} for m in ("Task: TF_CLOSING", "END: File Task Register")]
    return replay(spark, "spans", log_deliveries(log, _MIDDLE, *closing), stream_start_end).rows


# --------------------------------------------------------------------- ST4
def stream_dedup(files: DataFrame, keys=("short_filename",), within: dt.timedelta = dt.timedelta(days=1),
                 lateness: str = "1 day") -> DataFrame:
    """The earliest of each row of registrations of a key, where none follows the one before by more than ``within``.

    A registration so long after the last one of its key is a new one, and the
    earliest of what follows.  The state of a key holds its earliest row until
    the watermark passes the last one by ``within``; the order of arrival does
    not matter, so stream and batch give the same rows.  Of registrations at
    the same time the smallest by the other columns, in order, counts.
    """
    rest = [c for c in files.columns if c not in keys and c != "register_datetime"]
    earliest = F.min(F.struct("register_datetime", *rest))
    if files.isStreaming:
        e = watermarked(files, "register_datetime", lateness)
        first = e.groupBy(*keys, F.session_window("event_time", _interval(within))).agg(earliest.alias("f"))
    else:
        first = islands(files, list(keys), "register_datetime", within, {"f": earliest}, {"f": F.min})
    return first.select(*[F.col(c) if c in keys else F.col("f")[c].alias(c) for c in files.columns])


def first_arrivals(files: DataFrame, keys=("short_filename",), lateness: str = "1 day") -> DataFrame:
    """Of registrations of the same key, the first that arrives, at once; its repeats within the watermark delay are dropped.

    Which row stays depends on the order of arrival; ``stream_dedup`` waits, and does not.
    """
    return watermarked(files, "register_datetime", lateness).dropDuplicatesWithinWatermark(list(keys)).drop("event_time")


def _dedup_sql(key: str) -> str:
    return f"""
SELECT file_key, {key}, register_datetime FROM fx_files
WINDOW w AS (PARTITION BY {key} ORDER BY register_datetime, file_key)
QUALIFY register_datetime > lag(register_datetime) OVER w + INTERVAL 1 DAY OR lag(file_key) OVER w IS NULL
"""


def _registered(spark, sf, key: str) -> DataFrame:
    return fixtures(spark, sf).files.select("file_key", key, "register_datetime")


@query("stream_dedup", "ST4", _dedup_sql("short_filename"))
def q_stream_dedup(spark, sf):
    files = _registered(spark, sf, "short_filename")
    first = F.col("register_datetime") < ts_lit(_CUT)
    last = files.filter(~first).unionByName(closing_rows(files, "register_datetime"))
    return replay(spark, "dedup", [files.filter(first), last], stream_dedup).rows


@query("first_registrations", "ST4", _dedup_sql("path"))
def q_first_registrations(spark, sf):
    return stream_dedup(_registered(spark, sf, "path"), keys=("path",))
