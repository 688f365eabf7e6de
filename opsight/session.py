"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings every job in this library relies on.  They are applied only when a
# session is created here; an existing cluster session keeps its own values.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime broadcast only when the *measured* shuffle output is small.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for a large cluster (~1000 executors, ~100 TB of metadata and logs).
# Shuffles start wide and AQE coalesces them to ~256 MB per task; scan splits
# are large so a full scan of the log table is ~10^5 tasks; a skewed shuffle
# partition (one hot task or file day) is split by the skew-join rule; runtime
# bloom filters and dynamic partition pruning cut the big side of semi joins.
CLUSTER_CONF = {
    **BASE_CONF,
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    # Shuffle files outlive a lost executor (external shuffle service), so a
    # lost executor costs a re-run of its running tasks, not of whole stages.
    "spark.shuffle.service.enabled": "true",
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "opsight", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = (master or SparkConf().get("spark.master", "local")).startswith("local")
    conf = dict(BASE_CONF if local else CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    On a cluster this must already be set to a shared, fault-tolerant path.
    Only when it is unset (local tests) do we pick a fresh scratch folder.
    """
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and own.isDefined():             # the caller's choice stands
        return own.get()
    if not d:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared, "
                               "fault-tolerant folder (a machine-local folder would be lost with its executor)")
        d = tempfile.mkdtemp(prefix="opsight-ckpt-")   # local mode only (tests, bench)
        spark.conf.set("spark.checkpoint.dir", d)
    if not own.isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
