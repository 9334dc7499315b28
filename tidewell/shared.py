"""The folder that driver and executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; only a session within one process falls back to a folder of its own."""
    found = spark.conf.get(SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{SETTING} has to name a folder that driver and executors share")
        found = "/tmp/tidewell-checkpoints"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidewell-{name}-{uuid.uuid4().hex}"


MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
PLAIN = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


@contextmanager
def plain_log(spark: SparkSession, path: str):
    """Streams that start inside with a checkpoint in a local folder put their log's files in place by plain renames.

    There a rename is one step of the system's anyway, whichever interface asks for it; Spark's
    usual one starts several processes for each file, which is most of what a small batch costs. Other file
    systems keep the usual one.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = spark.conf.get(MANAGER, None)
    if old or where.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        yield
        return
    spark.conf.set(MANAGER, PLAIN)
    try:
        yield
    finally:
        spark.conf.unset(MANAGER)
