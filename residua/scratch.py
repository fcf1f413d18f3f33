"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_ROOTS: dict[str, str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system that it is on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the cluster's shared checkpoint folder, in a folder of the application that goes when it ends.

    Where the session names no folder (tests on one machine) a temporary one is set, once.
    """
    sc = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_SETTING, None) or sc.getConf().get(CHECKPOINT_SETTING) or sc.getCheckpointDir()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        sc.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/residua/{sc.applicationId}"
    if _ROOTS.get(sc.applicationId) != root:
        p, files = hadoop_path(spark, root)
        files.mkdirs(p)
        files.deleteOnExit(p)
        _ROOTS[sc.applicationId] = root
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them again."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for a table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p, files = hadoop_path(df.sparkSession, folder)
        files.delete(p, True)
