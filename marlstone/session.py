"""A session with the settings that the library's plans are made for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """On a cluster master stays as submitted; shuffle_partitions about 128 MB of shuffled data each."""
    b = SparkSession.builder.appName("marlstone")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def local(cpus: int | None = None, memory: str = "16g") -> SparkSession:
    n = cpus or os.cpu_count() or 1
    return session(f"local[{n}]", n, **{"spark__driver__memory": memory, "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false"})


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share; one is made only where none is set,
    on one machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage, in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()
