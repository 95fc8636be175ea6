"""Session helpers: a tuned local session for tests and bench, and the shared folder.

On a cluster the session comes from the platform; nothing here overrides settings
it already has. ``shared_dir`` reads ``spark.checkpoint.dir`` and only picks a
folder of its own when the setting is absent (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Number of partitions that text scans are dealt to; unset on a cluster, where files give the splits.
SCAN_PARTITIONS = "spark.tagwise.scanPartitions"

_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tagwise",
                  driver_memory: str = "16g") -> SparkSession:
    many = 2 * (os.cpu_count() or 4) if cores == "*" else 2 * int(cores)
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config(SCAN_PARTITIONS, str(many))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` (or the context's checkpoint dir) when set;
    otherwise, in local mode (tests), picks one and registers it as the checkpoint dir.
    """
    conf = spark.sparkContext.getConf()
    d = conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            d = None
    if not d:
        cp = spark.sparkContext.getCheckpointDir()
        if cp:
            d = os.path.dirname(cp.rstrip("/"))
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tagwise-shared-")
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the path's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one intermediate table."""
    return f"{shared_dir(spark)}/tagwise/{name}-{uuid.uuid4().hex[:12]}"


def few_tasks(df, rows: int, task_rows: int = 50_000):
    """The frame in no more partitions than the session has cores or than give each ``task_rows`` rows: jobs that
    run again and again over few rows would spend their time on tasks. Nothing is shuffled."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows)))


def checkpointed(df):
    """Reliable checkpoint into the shared folder (cuts lineage; survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df, name: str):
    """The rows as parquet files in the shared folder: readers take the columns that they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
