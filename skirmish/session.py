"""Spark session settings every job in this package assumes.

UTC session time zone (epoch seconds → dates must not drift), ANSI mode on
(Spark 4 default; division goes through ``try_divide``), adaptive execution
with skew-join splitting, and a checkpoint directory that is taken from the
cluster when it names one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what the planner can size; our explicit broadcasts are
    # limited to fixed-size dimensions.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "skirmish", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (clusters bring their own)."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings above to an existing session (driver-made)."""
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is; a private temporary folder is chosen only when nothing is configured
    (local tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="skirmish-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint directory for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the checkpoint directory and read back: computed
    once, with its lineage cut at a table that all executors can read."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_of(df: DataFrame, rows_each: int) -> int:
    """Partitions of about ``rows_each`` rows for ``df`` (counted; of a parquet
    table by its footers), at least one a core: what a task sorts or groups is
    then the same at every size of the input. AQE can't see to that, it merges
    partitions by their compressed bytes and splits only those of skewed joins."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_each))


def scale_conf(input_bytes: float, total_cores: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Settings sized for a large run (e.g. 100 TB over ~1000 executors).

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (at least 3 waves of the cluster's cores), and AQE coalesces them
    down to the advisory size after each shuffle; file splits match the same
    size, and skew splitting starts at twice it. Returned as a dict for
    ``SparkSession.builder.config`` or ``spark.conf.set``."""
    parts = max(int(input_bytes // target_partition_bytes), 3 * total_cores, 1)
    size = str(target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
    }
