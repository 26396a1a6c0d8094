"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset, a temporary folder is made if all runs on this machine; on a cluster
    that is an error, as executors would write to disks that nobody else reads."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stationlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
