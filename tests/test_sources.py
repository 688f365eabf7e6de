"""Sources and sinks: external CSV, pruned partition scan, parameters, sheets."""

import tempfile

from pyspark.sql import functions as F

from opsight.sources.fixtures import fixtures
from opsight.sources.readers import (
    external_csv, one_row, parameterized, partition_scan, to_sheet, to_view, write_partitioned,
)
from tests.conftest import SF_SMALL


def test_external_csv_round_trip(spark):
    names = fixtures(spark, SF_SMALL).manifest
    d = tempfile.mkdtemp(prefix="opsight-csv-")
    to_sheet(names, d)
    back = external_csv(spark, d, "name string", header=True)
    assert sorted(r.name for r in back.collect()) == sorted(r.name for r in names.collect())


def test_partition_scan_is_pruned(spark):
    files = fixtures(spark, SF_SMALL).files.select("file_key", "max_dw_date_key", "row_count")
    d = tempfile.mkdtemp(prefix="opsight-part-")
    write_partitioned(files, d, "max_dw_date_key", files_per_key=2)
    key = files.agg(F.max("max_dw_date_key")).first()[0]
    got = partition_scan(spark, d, "max_dw_date_key", [key])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and str(key) in plan.split("PartitionFilters")[1][:300]
    assert got.count() == files.filter(F.col("max_dw_date_key") == key).count()


def test_parameterized_query_and_view(spark):
    to_view(fixtures(spark, SF_SMALL).queue, "maint_queue")
    n = parameterized(spark, "SELECT count(*) AS n FROM maint_queue WHERE segment_name = :seg", seg="Brand#7").first().n
    assert n == fixtures(spark, SF_SMALL).queue.filter("segment_name = 'Brand#7'").count()
    assert one_row(spark).count() == 1


def test_create_table_as_select(spark):
    from opsight.sources.readers import to_table
    df = fixtures(spark, SF_SMALL).tasks.filter("task_type = 'FILE'")
    to_table(df, "opsight_ctas_check")
    try:
        assert spark.table("opsight_ctas_check").count() == df.count()
    finally:
        spark.sql("DROP TABLE IF EXISTS opsight_ctas_check")


def test_fixture_views_conform_to_declared_schemas(spark):
    import pytest as _pytest
    from opsight.sources.fixtures import FX_NAMES
    from opsight.sources.schemas import DDL, conform, schema
    fx = fixtures(spark, SF_SMALL)
    for n in FX_NAMES:
        df = fx.get(n)
        got = [(f.name, f.dataType.simpleString()) for f in conform(df, n[3:]).schema.fields]
        assert got == [(f.name, f.dataType.simpleString()) for f in schema(n[3:]).fields], n
    with _pytest.raises(ValueError):
        conform(fx.runs.drop("run_status"), "runs")
    assert set(DDL) == {n[3:] for n in FX_NAMES}


def test_framework_tables_bridge(spark):
    from pyspark.sql import functions as F
    from opsight.sources.framework import FRAMEWORK_COLUMNS, FRAMEWORK_TABLES, framework_tables
    fx = fixtures(spark, SF_SMALL)
    back = {v: k for k, v in FRAMEWORK_COLUMNS.items()}
    site = {}
    for name, table in FRAMEWORK_TABLES.items():
        df = fx.get("fx_" + name)
        site["SITE." + table] = df.select(*[F.col(c).alias(back.get(c, c.upper())) for c in df.columns])
    got = framework_tables(site.__getitem__, schema_prefix="SITE.")
    for name in FRAMEWORK_TABLES:
        want = fx.get("fx_" + name)
        assert got[name].columns[:len(want.columns)] == want.columns, name
    assert sorted(got["runs"].collect()) == sorted(fx.runs.collect())


# ------------------------------------------------------------- partitions, sinks, listings
def _days(spark, path, files_per_key=2):
    df = spark.range(0, 1000).selectExpr("id", "CAST(id % 10 AS INT) AS day", "CASE WHEN id % 10 < 3 AND id % 7 = 0 THEN 'FAILED' ELSE 'OK' END AS status")
    write_partitioned(df, path, "day", files_per_key)
    return df


def _names(path):
    import glob
    return {p[len(path):] for p in glob.glob(f"{path}/day=*/part-*")}


def test_partitions_of_a_joined_key_list_are_found_at_run_time(spark):
    d = tempfile.mkdtemp(prefix="opsight-dpp-")
    _days(spark, d)
    keys = spark.range(0, 100).selectExpr("CAST(id % 3 AS INT) AS day", "id").filter("id > 50")
    got = partition_scan(spark, d, "day", keys)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert got.count() == 300 and {r.day for r in got.select("day").distinct().collect()} == {0, 1, 2}


def test_a_long_key_list_is_not_broadcast(spark, monkeypatch):
    from opsight.sources import readers
    monkeypatch.setattr(readers, "KEYS_BROADCAST", 2)
    d = tempfile.mkdtemp(prefix="opsight-keys-")
    _days(spark, d)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = partition_scan(spark, d, "day", spark.range(0, 5).selectExpr("CAST(id AS INT) AS day"))
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_only_changed_partitions_are_rewritten(spark):
    from opsight.operators.actions import set_attribute
    from opsight.sources.readers import rewrite_changed
    d = tempfile.mkdtemp(prefix="opsight-rewrite-")
    df = _days(spark, d)
    before = _names(d)
    hit = F.col("status") == "FAILED"
    rewrite_changed(spark, d, "day", hit, lambda x: set_attribute(x, hit, "status", "RUNABLE"))
    after = _names(d)
    kept = {n for n in before & after}
    assert {n.split("/")[1] for n in kept} == {f"day={k}" for k in range(3, 10)}
    assert {n.split("/")[1] for n in after - kept} == {f"day={k}" for k in range(3)} and not (before - kept) & after
    got = {r.id: (r.day, r.status) for r in spark.read.parquet(d).collect()}
    assert got == {r.id: (r.day, "RUNABLE" if r.status == "FAILED" else r.status) for r in df.collect()}
    rewrite_changed(spark, d, "day", F.col("status") == "NONE", lambda x: x)       # nothing to change: no file moves
    assert _names(d) == after


def test_listing_of_a_folder(spark):
    import os
    from opsight.sources.readers import directory_listing
    d = tempfile.mkdtemp(prefix="opsight-ls-")
    os.mkdir(f"{d}/in")
    for name, text in (("in/a.dat", "12345"), ("in/b.dat", ""), ("in/c.txt", "x"), ("top.dat", "é"), ("in/d e+f.dat", "yz"), ("in/é.txt", "")):
        with open(f"{d}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    flat = sorted((r.name, r.length) for r in directory_listing(spark, f"{d}/in").collect())
    assert flat == [("a.dat", 5), ("b.dat", 0), ("c.txt", 1), ("d e+f.dat", 2), ("é.txt", 0)]
    deep = sorted((r.folder == "in", r.name, r.length) for r in directory_listing(spark, d, "*.dat", recursive=True).collect())
    assert deep == [(False, "top.dat", 2), (True, "a.dat", 5), (True, "b.dat", 0), (True, "d e+f.dat", 2)]


def test_forget_keeps_out_of_other_folders(spark):
    import os
    import pytest as _pytest
    from opsight.sources.readers import forget, shared_path
    other = tempfile.mkdtemp(prefix="opsight-other-")
    with _pytest.raises(ValueError):
        forget(spark, other)
    assert os.path.isdir(other)
    path = shared_path(spark, "gone")
    spark.range(3).write.parquet(path)
    forget(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
