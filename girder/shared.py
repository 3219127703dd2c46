"""Intermediate tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``. Where the
setting is absent, a session on one machine uses a folder under ``/tmp/checkpoints`` and any other is refused.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file:///tmp/checkpoints/girder-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/girder-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Rows of ids and numbers that one task writes with ease.
ROWS_A_TASK = 250_000


def staged(df: DataFrame, name: str, most: int | None = None, heavy: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a reread of the table and not
    a recomputation, and values such as generated ids stay what they were. most: a bound on the rows of a narrow table, where
    the caller has counted one; a table proven small is then written by few tasks, whatever the number of shuffle partitions. Those
    tasks make the rows too, unless making them is heavy: then the rows are dealt to them when made.
    """
    path = shared_path(df.sparkSession, name)
    if most is not None and (tasks := -(-max(most, 1) // ROWS_A_TASK)) < 200:
        df = df.repartition(tasks) if heavy else df.coalesce(tasks)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows of ``df``, so many, dealt by their keys to tasks of some ROWS_A_TASK rows, or to as many as can run at once where that is more.

    Spark merges the partitions of other shuffles until they are large, so what a task holds to sort them grows with the table up to that size; these stay as they are.
    """
    return df.repartition(max(-(-rows // ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism), *keys)
