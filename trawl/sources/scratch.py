"""New folders that driver and executors share, and their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def _top(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests on one machine, a folder of our own, removed at exit."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        top = tempfile.mkdtemp(prefix="trawl-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def scratch(spark: SparkSession) -> str:
    return f"{_top(spark)}/trawl-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Removes what this application has written below spark.checkpoint.dir; results read from there are gone then."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(_top(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    for at in fs.listStatus(path):
        if at.getPath().getName().startswith(f"trawl-{spark.sparkContext.applicationId}-"):
            fs.delete(at.getPath(), True)
