"""Intermediate results as Parquet in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which the driver and all executors share. It goes when the driver ends.

    Unset, only a local master, whose executors are the driver, gets a folder of this machine; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tablelens-checkpoint")
    path = f"{base.rstrip('/')}/tablelens-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone by now; what is left is in the cluster's own scratch folder
        return


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder of materialize() that nothing reads any more."""
    _remove(spark, path)


def materialize(df: DataFrame, path: str, compression: str = "zstd", **options) -> DataFrame:
    """Cuts the lineage by way of Parquet in the shared folder; a lost executor takes nothing with it. The job's shuffle files go once it is written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").options(compression=compression, **options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
