"""Sources and sinks the checks read from and write to.

Each is the plain Spark reader or writer for the reference's access path;
the functions only fix the options that matter at scale (explicit schemas,
partitioned JDBC reads, pruned partition scans, skew-safe partitioned
writes, binaryFile listings without file contents).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opsight.plans.registry import query
from opsight.session import checkpoint_dir

#: Partition keys up to this many are broadcast to prune a scan; a longer list is joined by shuffle.
KEYS_BROADCAST = 100_000


# ---------------------------------------------------------------- shared folder
def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder that the session names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared one; any other path is left alone."""
    if not path.startswith(checkpoint_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# ---------------------------------------------------------------- scans
def table_scan(spark: SparkSession, name: str) -> DataFrame:
    """Named table (optionally ``schema.table``) from the catalog."""
    return spark.table(name)


def view_scan(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def remote_table(spark: SparkSession, url: str, table: str, properties: dict | None = None,
                 partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """Table over a database link: a JDBC read, split on a numeric column when given.

    Without ``partition_column`` a JDBC read is one task; with it, Spark
    issues ``num_partitions`` range queries in parallel.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def external_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
                 header: bool = False) -> DataFrame:
    """External table over delimited text files, read with a declared schema (no inference)."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def partition_scan(spark: SparkSession, path: str, key: str, keys=None) -> DataFrame:
    """``t PARTITION FOR (k)``: a filter on the partition column, pruned at planning time.

    ``keys`` may be a list, or a DataFrame with the column ``key``: its distinct
    keys are then found at run time, and only their partitions are read (dynamic
    partition pruning).  Keys are counted before they are broadcast; a list of
    more than KEYS_BROADCAST is an ordinary semi join.
    """
    df = spark.read.parquet(path)
    if keys is None:
        return df
    if not isinstance(keys, DataFrame):
        return df.filter(F.col(key).isin(*keys))
    wanted = keys.select(F.col(key).cast(df.schema[key].dataType).alias(key)).distinct()
    few = wanted.limit(KEYS_BROADCAST + 1).count() <= KEYS_BROADCAST
    return df.join(F.broadcast(wanted) if few else wanted, key, "left_semi")


def directory_listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """``ls`` (``ls -R``): folder, file name, size and modification time, without reading file contents.

    Spark's file index leaves files without content out of its scans; they are
    taken from its list of paths, with length 0 and no time.
    """
    d = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
         .select("path", "length", "modificationTime"))
    short = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    every = spark.createDataFrame([(p,) for p in d.inputFiles()], "listed string")
    listed = every.select(short(F.url_decode(F.replace("listed", F.lit("+"), F.lit("%2B")))).alias("at"))
    known = d.select(short(F.col("path")).alias("at"), "length", "modificationTime")
    parts = F.split("at", "/")
    return listed.join(known, "at", "left").select(
        F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.coalesce("length", F.lit(0)).alias("length"),
        F.col("modificationTime").alias("modification_time"))


def one_row(spark: SparkSession) -> DataFrame:
    """``FROM DUAL``."""
    return spark.range(1).drop("id")


def parameterized(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Report query with bind variables (``:SEGMENT_NAME``) as named parameters."""
    return spark.sql(sql, args=params)


# ---------------------------------------------------------------- sinks
def write_partitioned(df: DataFrame, path: str, key: str, files_per_key: int = 8, mode: str = "overwrite") -> None:
    """Day-partitioned parquet (one directory per key value).

    Rows are spread over ``files_per_key`` writers per key by a hash salt, so
    a hot day is written by several tasks instead of one.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
    df.repartition(F.col(key), salt).write.mode(mode).partitionBy(key).parquet(path)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Write the partitions that ``df`` holds, whole, and leave all others as they are (dynamic overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def rewrite_changed(spark: SparkSession, path: str, key: str, predicate: Column, change) -> None:
    """``UPDATE`` of a partitioned table: only partitions with a row that meets ``predicate`` are read and written.

    ``change(df)`` returns the new rows of a partition's rows, with the same
    columns; a partition that loses all its rows stays.  The new files of all
    partitions take their places at the job's commit, so a lost executor or a
    failed job leaves the old ones.
    """
    touched = spark.read.parquet(path).filter(predicate).select(key)
    held = partition_scan(spark, path, key, touched)
    replace_partitions(change(held).select(held.columns), path, key)


def to_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """``CREATE TABLE AS SELECT``; with ``path`` the files stand there (an external table)."""
    w = df.write.mode(mode)
    (w.option("path", path) if path else w).saveAsTable(name)


def to_view(df: DataFrame, name: str) -> DataFrame:
    """``CREATE VIEW``: a session view over the plan (nothing is computed)."""
    df.createOrReplaceTempView(name)
    return df


def to_sheet(df: DataFrame, path: str) -> None:
    """Result of a check for a workbook: CSV with a header, written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)


# ---------------------------------------------------------------- registered
def listed_registrations(listing: DataFrame, files: DataFrame, name: str = "short_filename") -> DataFrame:
    """Each listed name with its length and how often it was registered."""
    known = files.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("registrations"))
    return listing.select("name", "length").join(known, "name", "left") \
        .withColumn("registrations", F.coalesce("registrations", F.lit(0)))


@query("listed_registrations", "F16-src", """
SELECT name, length, (SELECT count(*) FROM fx_files WHERE short_filename = name) AS registrations FROM fx_listing
""")
def q_listed_registrations(spark, sf):
    from opsight.sources.fixtures import fixtures
    fx = fixtures(spark, sf)
    return listed_registrations(fx.listing, fx.files)


@query("directory_listing", "F16-src", """
SELECT processing_status AS name, CAST(sum(length(short_filename) + 1) AS BIGINT) AS length, count(*) AS registrations
FROM fx_files GROUP BY ALL
""")
def q_directory_listing(spark, sf):
    """Folders of file lists (a folder for each status, a line for each file): listed, summed and set beside the registrations."""
    from opsight.sources.fixtures import fixtures
    files = fixtures(spark, sf).files
    path = shared_path(spark, "lists")
    files.select("processing_status", "short_filename").write.partitionBy("processing_status").text(path)
    listed = directory_listing(spark, path, "part-*", recursive=True)
    folders = listed.groupBy(F.substring_index("folder", "=", -1).alias("name")).agg(F.sum("length").alias("length"))
    return listed_registrations(folders, files, "processing_status")


@query("partition_trend", "S2.9-partition", """
SELECT date_key, count(*) AS cnt, CAST(sum(row_count) AS BIGINT) AS row_count
FROM (SELECT *, max_dw_date_key // 100 AS date_key FROM fx_files)
WHERE date_key IN (SELECT dw_date_key // 100 FROM fx_batches WHERE load_status = 'PROVISIONED' AND dw_date_key > 19990600)
GROUP BY date_key
""")
def q_partition_trend(spark, sf):
    """Rows of the month partitions since June 1999 for which a batch is provisioned; other partitions are not read."""
    from opsight.sources.fixtures import fixtures
    fx = fixtures(spark, sf)
    month = lambda c: F.floor(F.col(c) / 100).cast("int")
    path = shared_path(spark, "months")
    write_partitioned(fx.files.select("file_key", "row_count", month("max_dw_date_key").alias("date_key")), path, "date_key", files_per_key=1)
    wanted = fx.batches.filter("load_status = 'PROVISIONED' AND dw_date_key > 19990600").select(month("dw_date_key").alias("date_key"))
    return partition_scan(spark, path, "date_key", wanted).groupBy("date_key").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("row_count").alias("row_count"))


@query("rewrite_changed", "S2.8-sink", """
SELECT run_id, task_id, start_date, CAST(strftime(start_date, '%Y%m%d') AS INTEGER) AS day,
       CASE WHEN run_status = 'FAILED' AND rows_error > 97 THEN 'RUNABLE' ELSE run_status END AS run_status
FROM fx_runs
""")
def q_rewrite_changed(spark, sf):
    """A day-partitioned run table in which the failed runs of many errors become runnable: read back after the rewrite."""
    from opsight.functions.expr import key_of
    from opsight.operators.actions import set_status
    from opsight.sources.fixtures import fixtures
    path = shared_path(spark, "runs")
    runs = fixtures(spark, sf).runs.select("run_id", "task_id", "run_status", "start_date", "rows_error", key_of("start_date").alias("day"))
    write_partitioned(runs, path, "day", files_per_key=2)
    hit = (F.col("run_status") == "FAILED") & (F.col("rows_error") > 97)
    rewrite_changed(spark, path, "day", hit, lambda df: set_status(df, hit, "RUNABLE"))
    return spark.read.parquet(path).select("run_id", "task_id", "start_date", "day", "run_status")


@query("external_copy", "S2.9-csv", """
WITH clean AS (SELECT DISTINCT short_filename FROM fx_files WHERE length(short_filename) <= 36)
SELECT short_filename, min(processing_status) AS min_processing_status, max(processing_status) AS max_processing_status,
       count(*) AS file_count
FROM clean JOIN fx_files USING (short_filename) GROUP BY ALL
""")
def q_external_copy(spark, sf):
    """File names over an external text table, created as a table, and merged with their registrations."""
    from opsight.operators.actions import merge_update
    from opsight.sources.fixtures import fixtures
    files = fixtures(spark, sf).files
    text, copy, name = shared_path(spark, "external"), shared_path(spark, "ctas"), f"opsight_copy_{uuid.uuid4().hex}"
    to_sheet(files.select("short_filename"), text)
    names = external_csv(spark, text, "short_filename string", header=True).filter(F.length("short_filename") <= 36).distinct()
    none = F.lit(None)
    to_table(names.select("short_filename", none.cast("string").alias("min_processing_status"), none.cast("string").alias("max_processing_status"),
                          none.cast("long").alias("file_count")), name, path=copy)
    registered = files.groupBy("short_filename").agg(F.min("processing_status").alias("min_processing_status"),
                                                     F.max("processing_status").alias("max_processing_status"), F.count(F.lit(1)).alias("file_count"))
    target = spark.read.schema(table_scan(spark, name).schema).parquet(copy)
    spark.sql(f"DROP TABLE {name}")               # the entry only: the files stay
    return merge_update(target, registered, "short_filename", ["min_processing_status", "max_processing_status", "file_count"])


@query("report_sheet", "S2.9-report", """
SELECT op, status, partition_name, CAST(sizmb AS DOUBLE) AS sizmb FROM fx_queue WHERE segment_name = 'Brand#7'
""")
def q_report_sheet(spark, sf):
    """A report with a bind variable over a view, written as a sheet and read back."""
    from opsight.sources.fixtures import fixtures
    view, sheet = f"opsight_queue_{uuid.uuid4().hex}", shared_path(spark, "sheet")
    to_view(fixtures(spark, sf).queue, view)
    report = parameterized(spark, f"SELECT op, status, partition_name, CAST(sizmb AS DOUBLE) AS sizmb FROM {view} WHERE segment_name = :SEGMENT_NAME",
                           SEGMENT_NAME="Brand#7")
    to_sheet(report, sheet)
    spark.catalog.dropTempView(view)
    return external_csv(spark, sheet, report.schema, header=True)
