"""Distributed numbering: ``ROW_NUMBER() OVER (ORDER BY ...)`` without one task.

A global window sends every row to a single task.  Instead the rows are
range-partitioned and sorted, tagged with ``monotonically_increasing_id``
(partition index in the high bits, position in the low bits) and written once
to the shared folder: that is the only shuffle of the rows.  Offsets are the
running sum of the partitions' row counts - one narrow row a partition, as
many as ``spark.sql.shuffle.partitions`` says - and are broadcast to the
written rows.  Both passes read the same files, so numbers do not depend on
two sorts cutting the rows alike (column pruning, AQE and sampled bounds make
them differ), and a lost executor costs its running tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.sources.readers import shared_path

_LOW = (1 << 33) - 1


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Number rows 1..n in ``order`` (which must be a total order).  The rows are sorted and written when this is called."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = shared_path(spark, "numbered")
    tagged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id())
    tagged.write.parquet(path)
    rows = spark.read.schema(tagged.schema).parquet(path).withColumn("__pid", F.shiftright("__mid", 33))
    counts = rows.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off"))
    at = F.col("__mid").bitwiseAND(F.lit(_LOW))
    return rows.join(F.broadcast(offsets), "__pid").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__off") + at + 1).alias(name))
