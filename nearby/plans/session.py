"""Session settings that jobs of this library rely on."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests, a laptop) a temporary folder takes its place;
    on a cluster a folder of one machine would lose rows, so there it is an error.
    """
    set_by_job = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (set_by_job.rsplit("/", 1)[0] if set_by_job else None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", named) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not set_by_job:
        spark.sparkContext.setCheckpointDir(named)
    return named


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle and checkpoint files that nothing uses any more.

    It does so when the driver's garbage is collected, which in a loop of many small rounds may be long after disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
