"""Session helpers: a tuned local session for tests/bench and checkpoint-dir handling."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "scriptorium", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings this library is designed for.

    AQE is on so skewed chunk/document groups are split at runtime and small
    lookup sides are broadcast only after their real size has been measured. Master
    and shuffle partitions are left to the launcher unless given.
    """
    b = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    master = master or os.environ.get("SPARK_MASTER")
    if master:
        b = b.master(master)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory named by the cluster (``spark.checkpoint.dir``).

    On a cluster the setting must point to shared storage; it is only read here.
    Only when it is unset *and* the master is local (tests, bench) is a fresh
    scratch folder created, under ``$SCRIPTORIUM_SCRATCH`` where that is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage on a cluster")
    path = tempfile.mkdtemp(prefix="scriptorium-ckpt-", dir=os.environ.get("SCRIPTORIUM_SCRATCH"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint dir, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
