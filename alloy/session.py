"""SparkSession construction and cluster-safe helpers shared by every module."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes under which a side may be broadcast; anything larger takes the shuffle path.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes in memory per byte of compressed Parquet, at worst usual.
FILE_TO_MEMORY = 4


def build_session(master: str | None = None, app: str = "alloy",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE, skew-join and UTC time; UI off (no server/port beyond Spark's own).

    On a cluster (no ``local`` master) the cluster's own sizing wins: shuffle partitions
    and driver memory are only set for local runs or when passed explicitly. With AQE
    on, a high shuffle-partition count is coalesced at run time, so clusters should set
    it for their largest stage (e.g. input bytes / 128 MB).
    """
    builder = SparkSession.builder.appName(app)
    local = master is None or master.startswith("local")
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions or local:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8))
    if local:
        builder = builder.config("spark.driver.memory", os.environ.get("ALLOY_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared (HDFS/S3/ABFS) folder and is used
    as is. Only when it is unset (local tests) a scratch folder is created.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="alloy-ckpt-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (file sizes after pruning)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # pragma: no cover - stats unavailable
        return 1 << 62


def broadcast_if_small(df: DataFrame, limit_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind a size check; larger sides keep the shuffle join. The
    estimate starts from compressed files, so rows in memory count FILE_TO_MEMORY times."""
    return F.broadcast(df) if estimated_bytes(df) * FILE_TO_MEMORY <= limit_bytes else df


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a table that is read and cut to some columns."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
