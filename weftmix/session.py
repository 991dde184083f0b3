"""Session construction and the shared checkpoint folder.

On a cluster the session comes configured; ``get_session`` only fills in
settings that are unset so tests and the bench get sane local defaults.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # broadcast joins are requested explicitly (and only for bounded sides);
    # keep the automatic threshold small so Catalyst never broadcasts a side
    # whose size grows with the data.
    "spark.sql.autoBroadcastJoinThreshold": str(8 * 1024 * 1024),
    # checkpointed intermediate tables are removed once no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "weftmix") -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("WEFTMIX_DRIVER_MEMORY", "16g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object store) folder there; it is read
    from the session and never replaced. Only when it is unset on a ``local``
    master (tests) a scratch folder is created and registered; elsewhere a
    folder of the driver's machine would be lost to the executors, so that is
    an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="weftmix-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def size_shuffles(spark: SparkSession, input_bytes: int, target_bytes: int = 256 * 1024 * 1024,
                  min_partitions: int = 8) -> int:
    """Size ``spark.sql.shuffle.partitions`` for an input of ``input_bytes``
    so each shuffle partition holds about ``target_bytes`` (AQE then
    coalesces small ones and splits skewed ones), and align
    ``spark.sql.files.maxPartitionBytes`` and the AQE advisory size with the
    same target. The caller passes the bytes of the tables a job reads (e.g.
    from the file listing). Returns the partition count that was set."""
    n = max(int(min_partitions), -(-int(input_bytes) // int(target_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(int(target_bytes)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(int(min(target_bytes, 512 * 1024 * 1024))))
    return n
