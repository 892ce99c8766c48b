"""Session construction, table loading, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes (UTC, AQE).

    The master, the number of shuffle partitions and the driver's memory are set only where nothing else gives a master (spark-submit,
    PYSPARK_SUBMIT_ARGS, spark-defaults): then the session is local.
    """
    builder = SparkSession.builder.appName("tideline").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    submitted = "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") or "SPARK_REMOTE" in os.environ or any("spark.master" in a for a in sys.argv)
    if cpus is not None or not submitted:
        cpus = cpus or os.environ.get("BENCH_CPUS", "8")
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TEMPORARY: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder of its own; a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is not None:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if not _TEMPORARY:
        _TEMPORARY.append(tempfile.mkdtemp(prefix="tideline-"))
        atexit.register(shutil.rmtree, _TEMPORARY[0], True)
    return _TEMPORARY[0]


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
