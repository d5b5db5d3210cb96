"""How a table lies in its files, where that decides how many cores can work on it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master (as in tests) gets a temporary folder; on a cluster, whose executors couldn't see
    one, it is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='webloom-')}")
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir.rstrip("/")


def spread(df: DataFrame, task_bytes: int = 2 << 20) -> DataFrame:
    """A table of less than ``task_bytes`` a core, dealt evenly to as many tasks as there are cores; any other as it is.

    A row group is read by one task, so a small file keeps one core busy while an expensive expression runs over it.
    What this shuffles is bounded by the cores; larger tables are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * task_bytes else df
