"""Spark session defaults and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "hourcast") -> SparkSession:
    """Session with the settings every job here relies on.

    Timestamps are naive local times (TIMESTAMP_NTZ); the session zone is pinned
    to UTC so unix-second conversions are machine independent.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("HOURCAST_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset and
    the master is local (tests) a scratch folder is created and registered. On a
    cluster an unset folder is an error: executors cannot reach a local one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        return d
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="hourcast-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:
            pass
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def session_key(spark: SparkSession) -> str:
    """Identity of the running application (for per-session memos)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def files_key(spark: SparkSession, folder: str, names: tuple[str, ...]) -> tuple:
    """Names, sizes and times of the files of some tables: what a memo of a folder depends on."""
    jvm, out = spark._jvm, []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(table_path(folder, name))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            out += [(name, s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)]
    return tuple(sorted(out))


def cut_lineage(df, spark: SparkSession | None = None):
    """Write ``df`` as Parquet into the shared folder and read it back: the plan starts anew, columns
    can be pruned, and every executor sees the files."""
    spark = spark or df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
