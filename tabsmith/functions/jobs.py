"""Driver-side helpers around Spark jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def together(*thunks) -> list:
    """Run independent Spark jobs at the same time; results in order.

    Each thunk submits its own job, so short stages of one fill the cores that
    another leaves idle. The first failure is raised.
    """
    if len(thunks) < 2:
        return [t() for t in thunks]
    with ThreadPoolExecutor(max_workers=min(len(thunks), 8)) as pool:
        return [f.result() for f in [pool.submit(t) for t in thunks]]


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints, as the cluster names it.

    Where nothing is configured, a session on one machine gets a temporary folder; on a cluster, whose
    executors do not share their disks, it is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        folder = os.path.join(tempfile.gettempdir(), "tabsmith-checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints; it goes when the driver's JVM ends."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs and lost executors see the very same rows."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def pinned(df: DataFrame) -> DataFrame:
    """A report of a few rows (one per column, class or rule) as a local table.

    Reports are derived from each other; without this every one would repeat the work
    of those before it. Never used on data rows.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
