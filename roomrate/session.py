"""Spark session and shared-storage helpers.

Every materialisation (lineage cut, round-trip file, saved model) goes under the
shared folder the cluster names in ``spark.checkpoint.dir``. That setting is
read from the session. Where it is missing, a local master gets a folder of its
own under /tmp (tests, local runs); any other master is refused, as its machines
share no such folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK_CHECKPOINT_DIR = "/tmp/roomrate-checkpoints"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "roomrate") -> SparkSession:
    """Session for tests, bench and local runs (cluster jobs get theirs from spark-submit)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local default only if none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    master = sc.master.split("[")[0]
    if not configured and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    target = configured or _LOCAL_FALLBACK_CHECKPOINT_DIR
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def shared_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path under the shared checkpoint folder (unique per call unless told otherwise)."""
    base = ensure_checkpoint_dir(spark)
    leaf = list(parts)
    if unique:
        leaf.append(uuid.uuid4().hex)
    return "/".join([base.rstrip("/")] + leaf)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss; never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df from a Parquet table written into the shared folder: a lineage cut that keeps column pruning,
    filters and size statistics, and that any executor can read again after a loss."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")

