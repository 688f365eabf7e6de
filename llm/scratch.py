"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A stage that is read more than once is written as Parquet under that folder
and read back, so a lost executor costs its running tasks and nothing else,
and a long lineage is cut.  Nothing is ever kept on an executor's own disk.
"""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.session import checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm-" in parent:
                path = jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(conf).delete(path, True)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the ``wanted`` columns, each cast to its type.

    Tables may carry further columns; they are dropped here, so that they never
    meet an operator's own names.
    """
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in wanted.items()])
