"""Session defaults for running the operators at scale.

Adaptive execution re-plans at runtime: it coalesces the many small shuffle
partitions that the key-cardinality aggregates leave, splits skewed join
partitions and switches joins to broadcast when a side turns out small.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # The only automatic broadcasts: sides whose measured size is under 10 MB.
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "shopflow", conf: dict | None = None) -> SparkSession:
    """A session with the defaults above; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SCALE_DEFAULTS, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    _size_shuffles(spark, conf or {})
    return spark


def _size_shuffles(spark: SparkSession, conf: dict) -> None:
    """Start shuffles with enough partitions for the cluster.

    Adaptive execution only merges shuffle partitions (to the advisory
    size), it does not split them, so the first count must be large enough
    for the biggest shuffle: three per core of the cluster.  A count the user
    set (here or at submit time) is kept.
    """
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    submitted = spark.sparkContext.getConf()
    if any(k in conf or submitted.contains(k) for k in keys):
        return
    cores = spark.sparkContext.defaultParallelism
    # With dynamic allocation the job starts small; size for the cluster it may grow to.
    per_executor = int(submitted.get("spark.executor.cores", "1"))
    for key in ("spark.executor.instances", "spark.dynamicAllocation.maxExecutors"):
        value = submitted.get(key, "")
        if value.isdigit() and int(value) < 10**6:
            cores = max(cores, int(value) * per_executor)
    n = max(200, 3 * cores)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    A cluster names it; only a local session without one gets a scratch
    folder, so tests can checkpoint too.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="shopflow-ckpt-")
    sc.setCheckpointDir(path)
    return path
